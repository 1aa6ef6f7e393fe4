"""Graphlets inside windows: sets of W nodes of which all sets of k are looked at.

A window's induced graph is one number of W (W - 1) / 2 bits, found by one join with the edges. Each set of k places is then a
row of a small table of bit positions, and its graph is cut out of the window's number without another join.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphlets
from ..plans import catalogs
from .enumerate import induced_gint
from .normalize import adjacency, degrees

#: Pairs of nodes whose bits a LONG holds.
MOST = 11
MODES = ("MIN", "MAX", "DMIN", "DMAX", "LFMIN", "LFMAX")


def window_sets(windows: DataFrame, edges: DataFrame, w: int, k: int) -> DataFrame:
    """(window, nodes, gint, ordinal, perm, m): connected sets of k nodes of windows (window, nodes) of w nodes, at most 11."""
    if w > MOST:
        raise ValueError(f"windows have at most {MOST} nodes")
    spark = windows.sparkSession
    told = induced_gint(windows.withColumnRenamed("window", "set_id"), edges, w)
    big, small = graphlets.bit_of(w), graphlets.bit_of(k)
    rows = []
    for places in combinations(range(w), k):
        moved = [0] * len(small)
        for i, j in graphlets.pairs(k):
            moved[small[(i, j)]] = big[(places[i], places[j])]
        rows.append((list(places), moved[: len(graphlets.pairs(k))]))
    table = spark.createDataFrame(rows, "places array<int>, moved array<int>")
    bits = len(graphlets.pairs(k))
    value = reduce(
        lambda a, b: a + b,
        [F.shiftleft(F.call_function("shiftright", F.col("gint"), F.get("moved", F.lit(b))).bitwiseAND(1).cast("long"), b) for b in range(bits)],
    )
    cut = told.join(F.broadcast(table)).select(
        F.col("set_id").alias("window"), F.transform("places", lambda p: F.get("nodes", p)).alias("nodes"), value.alias("gint")
    )
    own = catalogs.canon(spark, k).filter("connected").select("ordinal", "m")
    named = catalogs.canon_map(spark, k).join(own, "ordinal")
    return cut.join(F.broadcast(named), "gint").select("window", "nodes", "gint", "ordinal", "perm", "m")


def representatives(sets: DataFrame, k: int, mode: str, least_edges: int = 0) -> DataFrame:
    """The sets that stand for a window: those of its smallest or largest ordinal (MIN, MAX), of a density next to one half,
    ties by ordinal (DMIN, DMAX), or of its rarest ordinal, ties by ordinal (LFMIN, LFMAX)."""
    if mode not in MODES:
        raise ValueError(f"{mode} is none of {MODES}")
    kept = sets.filter(F.col("m") >= least_edges)
    per = kept.groupBy("window", "ordinal").agg(F.count("*").alias("n"), F.first("m").alias("m"))
    tie = F.col("ordinal") if mode.endswith("MIN") else -F.col("ordinal")
    first = {"M": F.lit(0), "D": F.abs(2 * F.col("m") - k * (k - 1) // 2), "L": F.col("n")}[mode[0]]
    best = per.groupBy("window").agg(F.min_by("ordinal", F.struct(first.cast("long"), tie)).alias("ordinal"))
    return kept.join(best, ["window", "ordinal"], "left_semi")


def frequency(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("ordinal").agg(F.count("*").alias("count"))


def limited(chosen: DataFrame, edges: DataFrame, by: str, n: int) -> DataFrame:
    """The n sets of each window with the largest sum of degrees (DEG) or most edges to the outside (EDGE), ties by nodes."""
    deg = degrees(edges).select(F.col("id").alias("node"), "deg")
    keyed = chosen.withColumn("__s", F.concat_ws(",", "window", F.array_join("nodes", " ")))
    total = keyed.select("__s", F.explode("nodes").alias("node")).join(deg, "node").groupBy("__s").agg(F.sum("deg").alias("__d"))
    weight = F.col("__d") - (2 * F.col("m") if by == "EDGE" else F.lit(0))
    order = Window.partitionBy("window").orderBy(F.desc(weight), "nodes")
    return keyed.join(total, "__s").withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).drop("__s", "__d", "__r")


def by_degree(edges: DataFrame, w: int, starts: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(window, nodes): from each of starts(id), w nodes, always the neighbour of the set with the largest degree (or weight of
    weights(id, weight)), ties by the smaller id. Starts in parts of fewer than w nodes give none."""
    near = adjacency(edges)
    rank = weights if weights is not None else near.select("id", F.col("deg").cast("double").alias("weight"))
    far = near.select("id", F.explode("nbrs").alias("v")).join(rank.select(F.col("id").alias("v"), F.col("weight").alias("x")), "v")
    item = F.struct((-F.col("x")).alias("g"), F.col("v").alias("v"))
    ranked = far.groupBy(F.col("id").alias("w")).agg(F.sort_array(F.collect_list(item)).alias("near"))
    rows = starts.select(F.col("id").alias("window"), F.array("id").alias("nodes"), F.array().cast("array<struct<g: double, v: bigint>>").alias("left"), F.col("id").alias("w"))
    for _ in range(w - 1):
        met = rows.join(ranked, "w")
        left = F.array_sort(F.array_distinct(F.concat("left", F.filter("near", lambda c: ~F.array_contains("nodes", c["v"])))))
        rows = met.withColumn("left", left).filter(F.size("left") > 0).select(
            "window",
            F.concat("nodes", F.array(F.get("left", F.lit(0))["v"])).alias("nodes"),
            F.slice("left", F.lit(2), F.size("left")).alias("left"),
            F.get("left", F.lit(0))["v"].alias("w"),
        )
    return rows.select("window", "nodes")
