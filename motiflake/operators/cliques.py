"""Clique counts: exact, and by colours, thinned edges, sampled edges and dense parts."""

from __future__ import annotations

from math import comb, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import SPAN, draw
from ..plans.stash import stash
from .enumerate import cliques, oriented_by_degree
from .normalize import adjacency, soften


def exact(edges: DataFrame, k: int) -> DataFrame:
    return cliques(edges, k).agg(F.count("*").alias("cliques"))


def color_coding(edges: DataFrame, k: int, colors: int | None = None, seed: int = 1) -> DataFrame:
    """Cliques whose nodes have different colours, times the inverse of the chance of that. Edges of one colour go first."""
    c = colors or k
    shade = lambda x: draw(F.col(x), seed, "color") % c
    kept = edges.filter(shade("src") != shade("dst"))
    chance = factorial(c) / factorial(c - k) / c**k
    return exact(kept, k).select((F.col("cliques") / chance).alias("cliques"))


def edge_sampling(edges: DataFrame, k: int, keep: float, seed: int = 1) -> DataFrame:
    """Cliques of the graph with each edge kept by chance, over the chance that all of a clique's edges are."""
    kept = soften(edges, 1 - keep, seed)
    return exact(kept, k).select((F.col("cliques") / keep ** comb(k, 2)).alias("cliques"))


def graft(edges: DataFrame, k: int, share: float, seed: int = 1) -> DataFrame:
    """Cliques through edges taken by chance, over the share taken and a clique's number of edges. Growth starts from those
    edges' common neighbours and follows the degree order among them, so nothing else is listed."""
    near = adjacency(edges)
    lists = lambda c, n: near.select(F.col("id").alias(c), F.col("nbrs").alias(n))
    chosen = edges.filter(draw(F.col("src"), F.col("dst"), seed, "graft") < int(share * SPAN)).select("src", "dst")
    rows = chosen.join(lists("src", "one"), "src").join(lists("dst", "two"), "dst").select(F.array_intersect("one", "two").alias("left"))
    if k > 3:
        after = oriented_by_degree(edges).groupBy(F.col("u").alias("w")).agg(F.collect_list("v").alias("next"))
        for size in range(3, k):
            rows = rows.filter(F.size("left") >= k - size + 1).select("left", F.explode("left").alias("w"))
            rows = rows.join(after, "w").select(F.array_intersect("left", "next").alias("left"))
    hits = rows.agg(F.coalesce(F.sum(F.size("left")), F.lit(0)).alias("h")) if k > 2 else rows.agg(F.count("*").alias("h"))
    m = edges.agg(F.count("*").alias("m"))
    s = chosen.agg(F.count("*").alias("s"))
    return hits.join(F.broadcast(m)).join(F.broadcast(s)).select((F.col("h") * F.col("m") / F.col("s") / comb(k, 2)).alias("cliques"))


def turan_shadow(edges: DataFrame, k: int, samples: int, seed: int = 1, rounds: int = 8) -> DataFrame:
    """Cliques by sampling from dense parts: successor neighbourhoods are split until their density makes cliques of what
    is still wanted certain, or one node is; then sets are drawn from parts in proportion to the sets that they have, and the share that is a
    clique scales the count. Cliques found on the way down are counted too."""
    arcs = stash(oriented_by_degree(edges).select("u", "v"))
    after = arcs.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("next"))
    open_parts = stash(after.select(F.sort_array("next").alias("part"), F.lit(k - 1).alias("want")))
    leaves, sure = None, 0
    for _ in range(rounds):
        sized = open_parts.filter(F.size("part") >= F.col("want")).withColumn("pid", F.xxhash64("part", "want", F.monotonically_increasing_id()))
        sized = stash(sized)
        sure += sized.filter("want = 1").agg(F.sum(F.size("part"))).first()[0] or 0
        deep = sized.filter("want > 1")
        inner = deep.select("pid", "part", F.explode("part").alias("u")).join(arcs, "u").filter(F.array_contains("part", F.col("v")))
        counted = inner.groupBy("pid").agg(F.count("*").alias("m"))
        known = deep.join(counted, "pid", "left").withColumn("m", F.coalesce("m", F.lit(0)))
        n = F.size("part")
        dense = F.col("m") >= (1 - 1 / F.greatest(F.col("want") - 1, F.lit(1))) * n * (n - 1) / 2
        dense = dense | (F.col("want") == 2)
        sure += known.filter("want = 2").agg(F.sum("m")).first()[0] or 0
        done = stash(known.filter(dense & (F.col("want") > 2)).select("pid", "part", "want"))
        leaves = done if leaves is None else leaves.union(done)
        split = known.filter(~dense).select("pid", "part", "want", F.explode("part").alias("u")).join(after, "u")
        open_parts = stash(split.select(F.array_intersect("part", "next").alias("part"), (F.col("want") - 1).alias("want")))
        if not open_parts.limit(1).count():
            break
    else:
        rest = open_parts.filter(F.size("part") >= F.col("want")).select(F.xxhash64("part", "want").alias("pid"), "part", "want")
        leaves = leaves.union(rest)
    ways = F.lit(1.0)
    for i in range(k):
        ways = ways * F.when(F.col("want") > i, (F.size("part") - i) / (i + 1)).otherwise(1.0)
    weighed = stash(leaves.withColumn("ways", ways))
    total = weighed.agg(F.sum("ways").alias("t"), F.count("*").alias("n")).first()
    if not total["n"]:
        return edges.sparkSession.range(1).select(F.lit(float(sure)).alias("cliques"))
    # each part gets its share of the samples, the remainder by chance
    share = F.col("ways") / F.lit(total["t"]) * samples
    extra = F.when(draw(F.col("pid"), seed, "extra") / SPAN < share - F.floor(share), 1).otherwise(0)
    drawn = weighed.select("pid", "part", "want", (F.floor(share) + extra).cast("int").alias("times")).filter("times > 0")
    tries = drawn.select("pid", "part", "want", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("t"))
    order = F.array_sort(F.transform("part", lambda v: F.struct(draw(seed, F.col("pid"), F.col("t"), v).alias("d"), v.alias("v"))))
    sets = tries.select(
        F.xxhash64("pid", "t").alias("s"), "want", F.array_sort(F.transform(F.slice(order, F.lit(1), F.col("want")), lambda x: x["v"])).alias("set")
    )
    pairs = sets.select("s", "want", F.explode("set").alias("u"), "set").join(arcs, "u").filter(F.array_contains("set", F.col("v")))
    hits = pairs.groupBy("s", "want").agg(F.count("*").alias("m")).filter("m = want * (want - 1) / 2").count()
    n = sets.count()
    return edges.sparkSession.range(1).select(F.lit(float(sure) + (hits / n if n else 0.0) * total["t"]).alias("cliques"))


