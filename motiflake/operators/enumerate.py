"""All connected sets of k nodes of a graph, each exactly once.

A set grows from its smallest node. Beside its nodes a row holds the candidates that may still join it, each with a bit mask of the
members it is adjacent to, and the nodes that members are adjacent to. A new member brings as candidates only
neighbours that no earlier member had, so no set is made twice and nothing has to be deduplicated; the masks are the
induced graph, so the last round needs no join. There are k - 2 joins with the adjacency lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import graphlets
from .normalize import adjacency, both_ways

CANDIDATE = "array<struct<v: bigint, m: int>>"


def bits_of(mask: Column, member: int, k: int) -> Column:
    """Bits of the new member's adjacencies to earlier ones, given as a mask."""
    bit = graphlets.bit_of(k)
    terms = [F.shiftleft(F.shiftright(mask, q).bitwiseAND(1).cast("long"), bit[(member, q)]) for q in range(member)]
    return reduce(lambda a, b: a + b, terms)


def connected_sets(edges: DataFrame, k: int, roots: DataFrame | None = None) -> DataFrame:
    """(nodes ARRAY<LONG> in the order in which they joined, gint LONG in that order). With roots(id), only sets whose
    smallest node is among them."""
    near = adjacency(edges)
    start = near if roots is None else near.join(roots.select("id"), "id", "left_semi")
    rows = start.select(
        F.array("id").alias("nodes"),
        F.lit(0).cast("long").alias("gint"),
        F.array_union(F.array("id"), "nbrs").alias("seen"),
        F.transform(
            F.filter("nbrs", lambda x: x > F.col("id")), lambda x: F.struct(x.alias("v"), F.lit(1).alias("m"))
        ).alias("left"),
    )
    lists = near.select(F.col("id").alias("w"), "nbrs")
    for p in range(1, k):
        grown = rows.select("nodes", "gint", "seen", "left", F.posexplode("left").alias("at", "new")).select(
            F.concat("nodes", F.array("new.v")).alias("nodes"),
            (F.col("gint") + bits_of(F.col("new.m"), p, k)).alias("gint"),
            "seen",
            "left",
            "at",
            F.col("new.v").alias("w"),
        )
        if p == k - 1:
            return grown.select("nodes", "gint")
        joined = grown.join(lists, "w")
        old = F.transform(
            F.slice("left", F.col("at") + 2, F.size("left")),
            lambda c: F.struct(
                c["v"].alias("v"),
                F.when(F.array_contains("nbrs", c["v"]), c["m"] + (1 << p)).otherwise(c["m"]).alias("m"),
            ),
        )
        fresh = F.transform(
            F.filter(F.array_except("nbrs", "seen"), lambda x: x > F.get("nodes", F.lit(0))),
            lambda x: F.struct(x.alias("v"), F.lit(1 << p).alias("m")),
        )
        rows = joined.select(
            "nodes", "gint", F.array_union("seen", "nbrs").alias("seen"), F.concat(old, fresh).alias("left")
        )
    raise ValueError("k is 2 or more")


def sort_sets(sets: DataFrame, k: int) -> DataFrame:
    """The same sets with nodes ascending and gint in that order."""
    bit = graphlets.bit_of(k)
    table = F.array(*(F.lit(bit.get((i, j), 0)) for i in range(k) for j in range(k)))
    rank = [F.array_position("sorted", F.get("nodes", F.lit(i))) - 1 for i in range(k)]
    ranked = sets.withColumn("sorted", F.array_sort("nodes")).withColumn("rank", F.array(*rank)).withColumn("bits", table)
    terms = []
    for (i, j), b in ((p, bit[p]) for p in graphlets.pairs(k)):
        to = F.get("bits", (F.get("rank", F.lit(i)) * k + F.get("rank", F.lit(j))).cast("int"))
        terms.append(F.expr(f"shiftright(gint, {b}) & 1").cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), to))
    return ranked.select(F.col("sorted").alias("nodes"), reduce(lambda a, b: a + b, terms).alias("gint"))


def induced_gint(sets: DataFrame, edges: DataFrame, k: int, key: str = "set_id", directed: bool = False) -> DataFrame:
    """(key, nodes, gint) of sets (key, nodes) of k nodes, connected or not: pairs of places are joined with the edges. With
    directed, edges are arcs and gint is a directed number."""
    one = sets.select(key, "nodes", F.posexplode("nodes").alias("i", "u"))
    # a set's pairs of places come from its own row
    both = one.select(key, "nodes", "i", "u", F.posexplode("nodes").alias("j", "v")).filter("i <> j" if directed else "i > j")
    bit = graphlets.bit_of(k, directed)
    table = F.array(*(F.lit(bit.get((i, j), 0)) for i in range(k) for j in range(k)))
    value = F.call_function("shiftleft", F.lit(1).cast("long"), F.get(table, (F.col("i") * k + F.col("j")).cast("int")))
    if directed:
        known = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
        met = both.join(known.withColumn("hit", F.lit(1)), ["u", "v"], "left")
    else:
        ends = both.withColumn("src", F.least("u", "v")).withColumn("dst", F.greatest("u", "v"))
        met = ends.join(edges.select("src", "dst").withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    hit = F.coalesce(F.sum(F.when(F.col("hit") == 1, value)), F.lit(0).cast("long"))
    return met.groupBy(key).agg(F.first("nodes").alias("nodes"), hit.alias("gint"))


def oriented_by_degree(edges: DataFrame) -> DataFrame:
    """(u, v): each edge from its end of smaller degree, ties by id. No node has more than sqrt(2 m) successors, however large its
    degree, which keeps joins over successors small."""
    deg = both_ways(edges).groupBy("u").agg(F.count("*").alias("d"))
    one = edges.join(deg.select(F.col("u").alias("src"), F.col("d").alias("d1")), "src")
    two = one.join(deg.select(F.col("u").alias("dst"), F.col("d").alias("d2")), "dst")
    first = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") < F.col("dst")))
    return two.select(
        F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"),
        F.when(first, F.col("dst")).otherwise(F.col("src")).alias("v"),
    )


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """(nodes): every clique of k nodes once, grown along the degree order: a row's candidates are the successors
    that all its nodes have."""
    arcs = oriented_by_degree(edges)
    after = arcs.groupBy("u").agg(F.collect_list("v").alias("next"))
    rows = after.select(F.array("u").alias("nodes"), F.col("next").alias("left"))
    lists = after.select(F.col("u").alias("w"), "next")
    for size in range(2, k + 1):
        grown = rows.select(
            "nodes", "left", F.explode("left").alias("w")
        ).select(F.concat("nodes", F.array("w")).alias("nodes"), "left", "w")
        if size == k:
            return grown.select(F.array_sort("nodes").alias("nodes"))
        rows = grown.join(lists, "w").select("nodes", F.array_intersect("left", "next").alias("left")).filter(
            F.size("left") >= k - size
        )
    raise ValueError("k is 2 or more")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c."""
    at = lambda i: F.get("nodes", F.lit(i))
    return cliques(edges, 3).select(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))


def wedges(edges: DataFrame) -> DataFrame:
    """Number of paths of two edges, from degrees alone."""
    deg = both_ways(edges).groupBy("u").agg(F.count("*").alias("d"))
    return deg.agg((F.sum(F.col("d") * (F.col("d") - 1)) / 2).cast("long").alias("wedges"))
