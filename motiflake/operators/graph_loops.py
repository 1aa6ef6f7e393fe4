"""What takes as many rounds as the graph is deep: components, distances, cores, peeling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stash import drop, stash
from .normalize import both_ways, degrees, nodes

#: Edges that are broadcast as arrays at most.
ARRAY_EDGES = 4_000_000


def components(edges: DataFrame) -> DataFrame:
    """(id, cc): cc is the smallest node of the component. Labels spread to neighbours and then jump to their own label's
    label, so the rounds grow with the logarithm of the longest path."""
    both = stash(both_ways(edges))
    labels = stash(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("cc")))
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("cc").alias("near"))
        spread = near.join(labels, F.col("u") == labels.id).select("id", F.least("near", "cc").alias("cc"), F.col("cc").alias("old"))
        jump = labels.select(F.col("id").alias("cc"), F.col("cc").alias("next"))
        new = stash(spread.join(jump, "cc", "left").select("id", F.least("cc", "next").alias("cc"), "old"))
        changed = new.filter("cc <> old").limit(1).count()
        drop(labels)
        labels = new.select("id", "cc")
        if not changed:
            drop(both)
            return labels


def distances(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, id, hops) for all nodes within ``most`` hops of sources(id)."""
    both = both_ways(edges)
    seen = stash(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops")))
    front = seen
    for hop in range(1, most + 1):
        reached = front.join(both, front.id == both.u).select("source", F.col("v").alias("id")).distinct()
        front = stash(reached.join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen


def hop_distribution(edges: DataFrame, most: int | None = None, sources: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """(hops, pairs): ordered pairs of a source and a node that many hops away, up to ``most`` if given. Graphs of up to
    ``ARRAY_EDGES`` are searched as arrays, larger ones by joins with the same result, about ``block`` sources at a time."""
    edges = stash(edges.select("src", "dst"))
    if edges.count() <= ARRAY_EDGES:
        return _hops_in_arrays(edges, most, sources)
    return _hops_by_joins(edges, most, sources, block)


def _hops_in_arrays(edges: DataFrame, most: int | None, sources: DataFrame | None) -> DataFrame:
    """:func:`hop_distribution` of a graph that is broadcast as arrays. Batches of sources are dealt out over tasks."""
    from . import spans

    spark = edges.sparkSession
    own = spans.spanned(edges)
    chosen = None
    if sources is not None:
        chosen = np.isin(own.ids, sources.select(F.col("id").cast("long").alias("id")).distinct().toArrow().column("id").to_numpy())
    shared = spark.sparkContext.broadcast((own._replace(ids=own.ids[:0]), chosen))

    def search(batches):
        graph, among = shared.value
        found: dict[int, int] = {}
        now = None
        for rows in batches:
            for lo, hi, first, end in rows.itertuples(index=False):
                if now != (lo, hi):
                    now, span = (lo, hi), spans.slots(*graph.cut(lo, hi))
                of = np.arange(first, end) if among is None else first + np.flatnonzero(among[first:end])
                if len(of):
                    for i, n in enumerate(spans.hops(span, of - lo, most)):
                        found[i + 1] = found.get(i + 1, 0) + n
        yield pd.DataFrame({"hops": list(found), "n": list(found.values())}, dtype="int64")

    work = spark.createDataFrame(own.batches(512), "lo long, hi long, first long, end long").repartition(4 * spark.sparkContext.defaultParallelism).sortWithinPartitions("lo", "first")
    counts = stash(work.mapInPandas(search, "hops int, n long"))
    return counts.groupBy("hops").agg(F.sum("n").alias("pairs"))


def _hops_by_joins(edges: DataFrame, most: int | None, sources: DataFrame | None, block: int) -> DataFrame:
    """:func:`hop_distribution` of any graph: what a front reaches lies in the two fronts before it or is new, so no list of all seen
    pairs is kept."""
    both = stash(both_ways(edges))
    own = stash((nodes(edges) if sources is None else sources).select("id"))
    parts = max(1, -(-own.count() // block))
    counts = []
    for part in range(parts):
        start = own.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part) if parts > 1 else own
        front, hop = stash(start.select(F.col("id").alias("source"), "id")), 0
        before = front.limit(0)
        while most is None or hop < most:
            hop += 1
            reached = front.join(both, front.id == both.u).select("source", F.col("v").alias("id")).distinct()
            new = stash(reached.join(front, ["source", "id"], "left_anti").join(before, ["source", "id"], "left_anti"))
            n = new.count()
            if not n:
                break
            counts.append((hop, n))
            if hop > 1:
                drop(before)
            before, front = front, new
        drop(front)
    drop(both)
    return edges.sparkSession.createDataFrame(counts, "hops int, n long").groupBy("hops").agg(F.sum("n").alias("pairs"))


def cores(edges: DataFrame) -> DataFrame:
    """(id, core): the largest c such that the node is in a part of the graph where all have c neighbours or more. Estimates fall
    from the degree to the h-index of the neighbours' until none changes."""
    both = stash(both_ways(edges))
    state = stash(degrees(edges).select("id", F.col("deg").cast("long").alias("core")))
    while True:
        near = both.join(state.select(F.col("id").alias("v"), "core"), "v")
        # the h-index from counts per value: at most as many values as the node's own estimate
        own = near.join(state.select(F.col("id").alias("u"), F.col("core").alias("old")), "u")
        counted = own.groupBy("u", "old", F.least("core", "old").alias("value")).agg(F.count("*").alias("n"))
        listed = counted.groupBy("u", "old").agg(F.sort_array(F.collect_list(F.struct("value", "n")), False).alias("vs"))
        h = F.aggregate(
            "vs",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("h")),
            lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), F.greatest(s["h"], F.least(s["n"] + x["n"], x["value"])).alias("h")),
            lambda s: s["h"],
        )
        new = stash(listed.select(F.col("u").alias("id"), h.alias("core"), "old"))
        changed = new.filter("core <> old").limit(1).count()
        drop(state)
        state = new.select("id", "core")
        if not changed:
            drop(both)
            return state


def degeneracy(edges: DataFrame) -> DataFrame:
    return cores(edges).agg(F.max("core").alias("degeneracy"))


def importance(edges: DataFrame, floor: int) -> DataFrame:
    """(id, importance): nodes of degree below ``floor`` are peeled off, the least degree first, each round all at once, and leave
    their weight to their remaining neighbours in equal parts; what a node has at the end counts."""
    left = stash(edges.select("src", "dst"))
    weight = stash(nodes(edges).withColumn("w", F.lit(1.0)))
    while True:
        deg = degrees(left)
        low = deg.filter(F.col("deg") < floor).agg(F.min("deg").alias("d")).first()["d"]
        if low is None:
            return weight.select("id", F.round("w", 9).alias("importance"))
        gone = stash(deg.filter(F.col("deg") == low).select("id"))
        both = both_ways(left)
        kept_near = both.join(gone, both.u == gone.id, "left_semi").join(gone, F.col("v") == gone.id, "left_anti")
        parts = kept_near.groupBy("u").agg(F.count("*").alias("n"))
        given = kept_near.join(parts, "u").join(weight, F.col("u") == F.col("id")).groupBy("v").agg(F.sum(F.col("w") / F.col("n")).alias("more"))
        passed = weight.join(given, F.col("id") == F.col("v"), "left").join(parts.select(F.col("u").alias("id"), F.lit(0.0).alias("z")), "id", "left")
        weight = stash(passed.select("id", F.coalesce("z", F.col("w") + F.coalesce("more", F.lit(0.0))).alias("w")))
        one = left.join(gone, left.src == gone.id, "left_anti")
        left = stash(one.join(gone, one.dst == gone.id, "left_anti"))
