"""Alignment indexes: deterministic expansion, patches of near index lines, seeds common to two networks, node pairs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphlets
from .enumerate import bits_of
from .normalize import adjacency, both_ways, numbered


def expand(edges: DataFrame, heuristic: DataFrame, k: int, top: int = 0, skip_thousandths: int = 0) -> DataFrame:
    """(nodes, gint, path): from every node, ways to grow to k nodes that take, at each step, all neighbours whose
    heuristic (id, heur) is among the ``top`` highest different values (0: all; a share of the highest may be skipped). path
    orders the ways as a search would find them: by heuristic from high to low, then by id. One way per set of nodes: the first.
    """
    ranked = heuristic.select("id", "heur")
    near = adjacency(edges).join(ranked, "id")
    # each node knows its neighbours with their heuristics
    far = both_ways(edges).join(ranked.select(F.col("id").alias("v"), F.col("heur").alias("h")), "v")
    lists = far.groupBy("u").agg(F.sort_array(F.collect_list(F.struct((-F.col("h")).alias("g"), F.col("v").alias("v")))).alias("near"))
    item = "array<struct<g: double, v: bigint, m: int>>"
    lists = lists.select(F.col("u").alias("w"), F.col("near").cast("array<struct<g: double, v: bigint>>").alias("near"))
    order = lambda g, v: F.struct(g.cast("double").alias("g"), v.alias("v"))
    rows = near.select(
        F.array("id").alias("nodes"),
        F.lit(0).cast("long").alias("gint"),
        F.array().cast(item).alias("left"),
        F.array(order(-F.col("heur"), F.col("id"))).alias("path"),
        F.col("id").alias("w"),
    )
    for p in range(1, k):
        met = rows.join(lists, "w")
        mask = 1 << (p - 1)
        ids = F.transform("near", lambda x: x["v"])
        old = F.transform(
            "left",
            lambda c: F.struct(
                c["g"].alias("g"), c["v"].alias("v"), F.when(F.array_contains("near_ids", c["v"]), c["m"] + mask).otherwise(c["m"]).alias("m")
            ),
        )
        known = F.concat(F.transform("left", lambda c: c["v"]), "nodes")
        fresh = F.transform(
            F.filter("near", lambda x: ~F.array_contains("known", x["v"])),
            lambda x: F.struct(x["g"].alias("g"), x["v"].alias("v"), F.lit(mask).alias("m")),
        )
        met = met.withColumn("near_ids", ids).withColumn("known", known)
        met = met.withColumn("left", F.sort_array(F.concat(old, fresh)))
        values = F.array_sort(F.array_distinct(F.transform("left", lambda c: c["g"])))
        met = met.withColumn("values", values)
        first = F.floor(F.size("values") * skip_thousandths / 1000).cast("int")
        allowed = F.slice("values", first + 1, F.lit(top) if top else F.greatest(F.size("values"), F.lit(1)))
        met = met.withColumn("allowed", allowed)
        grown = met.select(
            "nodes", "gint", "left", "path", F.explode(F.filter("left", lambda c: F.array_contains("allowed", c["g"]))).alias("new")
        )
        rows = grown.select(
            F.concat("nodes", F.array("new.v")).alias("nodes"),
            (F.col("gint") + bits_of(F.col("new.m"), p, k)).alias("gint"),
            F.filter("left", lambda c: c["v"] != F.col("new.v")).alias("left"),
            F.concat("path", F.array(order(F.col("new.g"), F.col("new.v")))).alias("path"),
            F.col("new.v").alias("w"),
        )
    sets = rows.select(F.array_sort("nodes").alias("key"), F.struct("path", "nodes", "gint").alias("way"))
    return sets.groupBy("key").agg(F.min("way").alias("way")).select("way.nodes", "way.gint", "way.path")


@lru_cache(maxsize=1 << 16)
def _canonical(gint: int, k: int) -> tuple[int, list[int], int]:
    low, perm = graphlets.canonicalize(gint, k)
    same = graphlets.images(low, k) == low
    orbit = graphlets._moves(k)[0][same].min(axis=0)
    ways = int(np.prod([float(np.prod(range(1, n + 1))) for n in np.bincount(orbit)]))
    return low, perm, ways


def canonical_rows(sets: DataFrame, k: int, most: int = 1) -> DataFrame:
    """sets with canonical number, perm and ways (in how many ways its nodes could stand, by orbits), those with at most ``most``
    ways (0: all). Each different number is worked out once; no table of all graphs of k nodes is needed, so k may be 8."""

    @F.pandas_udf("canon long, perm array<int>, ways long")
    def told(gint: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_canonical(int(g), k) for g in gint], columns=["canon", "perm", "ways"])

    numbers = sets.select("gint").distinct().withColumn("c", told("gint")).select("gint", "c.*")
    return sets.join(numbers if most == 0 else numbers.filter(F.col("ways") <= most), "gint")


def index(edges: DataFrame, heuristic: DataFrame, k: int, top: int = 2, most: int = 1) -> DataFrame:
    """(line_no, key, nodes): the index of a network, in the order in which a search finds its lines. key is the canonical
    number and the place of canonical node 0; nodes stand in canonical order."""
    rows = canonical_rows(expand(edges, heuristic, k, top), k, most)
    told = rows.select(
        "path",
        F.concat_ws("+o", F.col("canon").cast("string"), F.get("perm", F.lit(0)).cast("string")).alias("key"),
        F.transform("perm", lambda i: F.get("nodes", i)).alias("nodes"),
    )
    return numbered(told, "path", into="line_no").select("line_no", "key", "nodes")


def patches(lines: DataFrame, edges: DataFrame, near: int = 2, common: int = 1) -> DataFrame:
    """(key, nodes): pairs of index lines at most ``near`` lines apart that share ``common`` nodes or more (a negative value of
    either means exactly that many). The line with the smaller key comes first; nodes are its own alone, then the shared
    ones, then the other's alone. The key names both keys, the places of shared nodes, and the edges between the others.
    """
    reach = range(-near, -near + 1) if near < 0 else range(1, near + 1)
    a = lines.select("line_no", F.col("key").alias("k1"), F.col("nodes").alias("n1"))
    b = lines.select(F.col("line_no").alias("other"), F.col("key").alias("k2"), F.col("nodes").alias("n2"))
    tried = a.withColumn("other", F.explode(F.array(*(F.col("line_no") + d for d in reach)))).join(b, "other")
    shared = F.size(F.array_intersect("n1", "n2"))
    close = tried.filter(shared == -common if common < 0 else shared >= common)
    first = F.col("k1") <= F.col("k2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    both = close.select(
        F.concat_ws("-", F.col("line_no").cast("string"), F.col("other").cast("string")).alias("pair"),
        pick("k1", "k2").alias("lk"), pick("k2", "k1").alias("rk"), pick("n1", "n2").alias("l"), pick("n2", "n1").alias("r"),
    )
    own = both.withColumn("lone", F.array_except("l", "r")).withColumn("rone", F.array_except("r", "l"))
    # edges between nodes of one line alone and of the other alone
    pairs = own.select("pair", "l", "r", F.explode("lone").alias("u"), "rone").select("pair", "l", "r", "u", F.explode("rone").alias("v"))
    met = pairs.join(both_ways(edges), ["u", "v"], "left_semi")
    place = lambda side, x: (F.array_position(side, F.col(x)) - 1).cast("int")
    by_left = met.groupBy("pair", place("l", "u").alias("i")).agg(F.sort_array(F.collect_list(place("r", "v"))).alias("js"))
    part = F.struct("i", F.concat_ws(":", F.col("i").cast("string"), F.concat_ws(",", F.col("js").cast("array<string>"))).alias("t"))
    extra = by_left.groupBy("pair").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joined = own.join(extra, "pair", "left")
    matched = F.filter("l", lambda x: F.array_contains("r", x))
    poses = F.transform(
        matched, lambda x: F.concat_ws(":", (F.array_position("l", x) - 1).cast("string"), (F.array_position("r", x) - 1).cast("string"))
    )
    edges_text = F.coalesce(F.array_join(F.transform("parts", lambda p: p["t"]), "-"), F.lit(""))
    key = F.concat(F.col("lk"), F.lit("-"), F.col("rk"), F.lit(";"), F.array_join(poses, ","), F.lit(";"), edges_text)
    return joined.select(
        key.alias("key"),
        F.concat(F.filter("l", lambda x: ~F.array_contains("r", x)), matched, F.filter("r", lambda x: ~F.array_contains("l", x))).alias("nodes"),
    )


def seeds(one: DataFrame, two: DataFrame) -> DataFrame:
    """(key, nodes1, nodes2): keys that stand in exactly one line of each index (key, nodes)."""
    alone = lambda x, name: x.groupBy("key").agg(F.count("*").alias("n"), F.first("nodes").alias(name)).filter("n = 1").drop("n")
    return alone(one, "nodes1").join(alone(two, "nodes2"), "key").distinct()


def node_pairs(found: DataFrame) -> DataFrame:
    """(n1, n2): pairs of nodes in the same places of seeds, each of which the other votes for most often (ties count)."""
    at = found.select(F.explode(F.arrays_zip("nodes1", "nodes2")).alias("p")).select(
        F.col("p.nodes1").alias("n1"), F.col("p.nodes2").alias("n2")
    )
    votes = at.groupBy("n1", "n2").agg(F.count("*").alias("votes"))
    favourite = lambda c: F.max("votes").over(Window.partitionBy(c)) == F.col("votes")
    judged = votes.withColumn("a", favourite("n1")).withColumn("b", favourite("n2"))
    return judged.filter("a and b").select("n1", "n2")


def seed_metrics(found: DataFrame, orthologs: DataFrame) -> DataFrame:
    """One row: seeds, mean size, node correctness (squares of a seed's right nodes over its size, over all nodes), pairs, and
    right pairs. orthologs is (n1, n2)."""
    at = found.distinct().select(F.struct("key", "nodes1", "nodes2").alias("s"), F.size("nodes1").alias("size"), F.explode(F.arrays_zip("nodes1", "nodes2")).alias("p")).select(
        "s", "size", F.col("p.nodes1").alias("n1"), F.col("p.nodes2").alias("n2")
    )
    right = orthologs.select("n1", "n2").distinct().withColumn("right", F.lit(1))
    per = at.join(right, ["n1", "n2"], "left").groupBy("s").agg(F.first("size").alias("size"), F.sum(F.coalesce("right", F.lit(0))).alias("r"))
    total = per.agg(
        F.count("*").alias("seeds"),
        F.round(F.avg("size"), 9).alias("avg_size"),
        F.round(F.sum(F.col("r") * F.col("r") / F.col("size")) / F.sum("size"), 9).alias("node_correctness"),
    )
    own = node_pairs(found)
    drawn = own.join(right, ["n1", "n2"], "left").agg(F.count("*").alias("pairs"), F.sum(F.coalesce("right", F.lit(0))).alias("right_pairs"))
    return total.join(F.broadcast(drawn))


def node_frequency(rows: DataFrame) -> DataFrame:
    """(node, count): in how many index lines a node stands."""
    return rows.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("count"))


