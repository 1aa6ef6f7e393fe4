"""Classes of sets, and what is counted over them: frequencies, degree vectors, index rows, communities."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import graphlets
from ..plans import catalogs
from .normalize import degrees


@lru_cache(maxsize=1 << 16)
def _named(gint: int, k: int) -> tuple[int, list[int]]:
    low, perm = graphlets.canonicalize(gint, k)
    return _ranks(k)[low], perm


@lru_cache(maxsize=None)
def _ranks(k: int) -> dict[int, int]:
    return {g: i for i, g in enumerate(graphlets.canonical_numbers(k))}


def classify(sets: DataFrame, k: int, directed: bool = False) -> DataFrame:
    """sets with ordinal and perm (canonical node j is nodes[perm[j]]). Up to 15 node pairs by a broadcast table of fixed size; beyond,
    each different number is brought to canonical form once."""
    spark = sets.sparkSession
    if len(graphlets.pairs(k, directed)) <= 15:
        return sets.join(F.broadcast(catalogs.canon_map(spark, k, directed)), "gint")
    numbers = sets.select("gint").distinct()

    @F.pandas_udf("ordinal int, perm array<int>")
    def named(gint: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_named(int(g), k) for g in gint], columns=["ordinal", "perm"])

    told = numbers.withColumn("c", named("gint")).select("gint", "c.ordinal", "c.perm")
    return sets.join(told, "gint")


@lru_cache(maxsize=1 << 16)
def _form(gint: int, k: int) -> tuple[int, list[int]]:
    """Least number among relabellings that keep nodes in the order of their score, and the perm: what larger graphs than
    the catalogs hold are named by."""
    from itertools import permutations, product

    near = graphlets.neighbours(gint, k)
    score = [sum(len(near[w]) ** 3 for w in near[v]) for v in range(k)]
    groups = [[v for v in range(k) if score[v] == s] for s in sorted(set(score))]
    bits, edges = graphlets.bit_of(k), graphlets.decode(gint, k)
    best: tuple[int, list[int]] | None = None
    for choice in product(*(permutations(g) for g in groups)):
        perm = [v for part in choice for v in part]
        at = {v: i for i, v in enumerate(perm)}
        number = sum(1 << bits[(at[i], at[j])] for i, j in edges)
        if best is None or number < best[0]:
            best = (number, perm)
    return best


def dynamic_form(sets: DataFrame, k: int) -> DataFrame:
    """sets with form and perm for graphs beyond the catalogs, up to 11 nodes: nodes are ordered by the sum of their
    neighbours' cubed degrees, and only nodes of equal sums change places. Its forms are names of their own, not canonical numbers."""

    @F.pandas_udf("form long, perm array<int>")
    def formed(gint: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_form(int(g), k) for g in gint], columns=["form", "perm"])

    told = sets.select("gint").distinct().withColumn("c", formed("gint")).select("gint", "c.form", "c.perm")
    return sets.join(told, "gint")


def counts(sets: DataFrame, k: int, directed: bool = False) -> DataFrame:
    """(ordinal, count): numbers are counted before they are named, so what is shuffled is a row per task and number."""
    return classify(sets.groupBy("gint").agg(F.count("*").alias("c")), k, directed).groupBy("ordinal").agg(
        F.sum("c").alias("count")
    )


def with_absent(spark: SparkSession, found: DataFrame, k: int, column: str) -> DataFrame:
    """found for every connected graphlet, 0 where it has none."""
    own = catalogs.canon(spark, k).filter("connected").select("ordinal")
    return own.join(found, "ordinal", "left").withColumn(column, F.coalesce(F.col(column), F.lit(0)))


def frequency(sets: DataFrame, k: int) -> DataFrame:
    """(ordinal, count) for every connected graphlet."""
    return with_absent(sets.sparkSession, counts(sets, k), k, "count")


def concentration(sets: DataFrame, k: int) -> DataFrame:
    """(ordinal, concentration): shares of all sets."""
    found = frequency(sets, k)
    total = found.agg(F.sum("count").alias("total"))
    return found.join(F.broadcast(total)).select(
        "ordinal", F.round(F.col("count") / F.col("total"), 9).alias("concentration")
    )


def star_multiplier(edges: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row: stars in the graph by degrees, stars in the counts (ordinal, count), and their ratio. It scales shares of
    samples to whole numbers of graphlets."""
    own = catalogs.canon(edges.sparkSession, k).select("ordinal", "stars")
    choose = F.lit(1).cast("decimal(38,0)")
    for i in range(k - 1):
        choose = choose * (F.col("deg") - i)
    factorial = 1
    for i in range(2, k):
        factorial *= i
    by_degree = degrees(edges).filter(F.col("deg") >= k - 1).agg((F.sum(choose.cast("double")) / factorial).alias("graph_stars"))
    by_count = found.join(F.broadcast(own), "ordinal").agg(F.sum(F.col("count") * F.col("stars")).cast("double").alias("count_stars"))
    return by_degree.join(F.broadcast(by_count)).withColumn("multiplier", F.round(F.col("graph_stars") / F.col("count_stars"), 9))


def _members(classified: DataFrame) -> DataFrame:
    """A row per set and canonical node: ordinal, pos, node."""
    return classified.select("ordinal", "nodes", F.posexplode("perm").alias("pos", "at")).select(
        "ordinal", "pos", F.expr("nodes[at]").alias("node")
    )


def orbit_degrees(sets: DataFrame, k: int) -> DataFrame:
    """(node, orbit, count): in how many sets a node stands in an orbit."""
    table = catalogs.orbits(sets.sparkSession, k).select("ordinal", "pos", "orbit")
    return (
        _members(classify(sets, k)).join(F.broadcast(table), ["ordinal", "pos"]).groupBy("node", "orbit").agg(F.count("*").alias("count"))
    )


def graphlet_degrees(sets: DataFrame, k: int) -> DataFrame:
    """(node, ordinal, count)."""
    return _members(classify(sets, k)).groupBy("node", "ordinal").agg(F.count("*").alias("count"))


def orbit_table(sets: DataFrame, k: int) -> DataFrame:
    """A row per node with a column per connected orbit, o0 on; for 4 and 5 nodes in the usual orbit order."""
    order = graphlets.ORCA_ORBITS.get(k) or list(range(len(graphlets.connected_orbits(k))))
    place = catalogs.orbits(sets.sparkSession, k).select("orbit", "connected_orbit").distinct()
    column = F.array_position(F.array(*map(F.lit, order)), F.col("connected_orbit")) - 1
    long = orbit_degrees(sets, k).join(F.broadcast(place), "orbit").select("node", column.cast("int").alias("col"), "count")
    wide = long.groupBy("node").pivot("col", list(range(len(order)))).agg(F.sum("count"))
    return wide.select("node", *(F.coalesce(F.col(str(i)), F.lit(0)).alias(f"o{i}") for i in range(len(order))))


def graphlet_table(sets: DataFrame, k: int) -> DataFrame:
    """A row per node with a column per canonical graph, connected or not, g0 on."""
    n = len(graphlets.canonical_numbers(k))
    wide = graphlet_degrees(sets, k).groupBy("node").pivot("ordinal", list(range(n))).agg(F.sum("count"))
    return wide.select("node", *(F.coalesce(F.col(str(i)), F.lit(0)).alias(f"g{i}") for i in range(n)))


def graphlet_totals(vectors: DataFrame, k: int) -> DataFrame:
    """(ordinal, count) from orbit degrees (node, orbit, count): a graphlet's orbit counts each of its sets once per node in
    that orbit, and all of a graphlet's orbits together k times."""
    place = catalogs.orbits(vectors.sparkSession, k).select("ordinal", "orbit").distinct()
    summed = vectors.join(F.broadcast(place), "orbit").groupBy("ordinal").agg(F.sum("count").alias("c"))
    return summed.select("ordinal", (F.col("c") / k).cast("long").alias("count"))


def names(spark: SparkSession, k: int, style: str) -> DataFrame:
    """(ordinal, name): how a graphlet is written: ordinal, decimal, binary, or its place in the upper numbering."""
    own = catalogs.canon(spark, k)
    width = len(graphlets.pairs(k))
    if style == "upper":
        return catalogs.crosswalk(spark, k).select(
            F.col("lower_ordinal").cast("int").alias("ordinal"), F.col("upper_ordinal").cast("string").alias("name")
        )
    name = {
        "ordinal": F.col("ordinal").cast("string"),
        "decimal": F.col("gint").cast("string"),
        "binary": F.lpad(F.bin("gint"), width, "0"),
    }[style]
    return own.select("ordinal", name.alias("name"))


def unambiguous(spark: SparkSession, k: int, most: int = 1) -> DataFrame:
    """Ordinals of which the product of the factorials of their orbits' sizes is at most ``most``; 0 allows all."""
    sizes = catalogs.orbits(spark, k).groupBy("ordinal", "orbit").agg(F.count("*").alias("n"))
    product = F.aggregate(F.collect_list(F.expr("factorial(int(n))")), F.lit(1).cast("long"), lambda a, b: a * b)
    ways = sizes.groupBy("ordinal").agg(product.alias("ways"))
    return ways if most == 0 else ways.filter(F.col("ways") <= most)


def index_rows(
    sets: DataFrame, k: int, style: str = "ordinal", rooted: bool = False, least_edges: int = 0, ambiguity: int = 0
) -> DataFrame:
    """(id, nodes): each set as its graphlet's name and its nodes in canonical order. rooted adds ``+o`` and the place of
    canonical node 0; least_edges and ambiguity leave graphlets out."""
    spark = sets.sparkSession
    own = catalogs.canon(spark, k).filter(F.col("connected") & (F.col("m") >= least_edges)).select("ordinal")
    if ambiguity:
        own = own.join(unambiguous(spark, k, ambiguity).select("ordinal"), "ordinal", "left_semi")
    told = own.join(names(spark, k, style), "ordinal")
    rows = classify(sets, k).join(F.broadcast(told), "ordinal")
    name = F.concat("name", F.lit("+o"), F.get("perm", F.lit(0)).cast("string")) if rooted else F.col("name")
    in_order = F.transform("perm", lambda i: F.get("nodes", i))
    return rows.select(name.alias("id"), in_order.alias("nodes"))


def orbit_rows(sets: DataFrame, k: int) -> DataFrame:
    """(id, groups): nodes in canonical order, those of one orbit joined by ``:``, orbits by their first place."""
    spark = sets.sparkSession
    whole = graphlets.catalog(k)
    rows = []
    for o, orbit in enumerate(whole.orbits):
        groups: dict[int, list[int]] = {}
        for pos, x in enumerate(orbit):
            groups.setdefault(x, []).append(pos)
        rows.append((o, list(groups.values())))
    table = spark.createDataFrame(rows, "ordinal int, groups array<array<int>>")
    joined = classify(sets, k).join(F.broadcast(table), "ordinal")
    node = lambda pos: F.get("nodes", F.get("perm", pos)).cast("string")
    text = F.transform("groups", lambda g: F.array_join(F.array_sort(F.transform(g, node)), ":"))
    return joined.select(F.col("ordinal").cast("string").alias("id"), F.array_join(text, " ").alias("groups"))


def communities(sets: DataFrame, k: int, by_orbit: bool = True, symmetric: bool = False) -> DataFrame:
    """(node, id, count, neighbours): in how many sets a node stands in an orbit (or graphlet), and which nodes it meets there
    over edges that are no bridges. Each such edge of a canonical graph tells its first node of its second only, unless
    symmetric."""
    spark = sets.sparkSession
    place = catalogs.orbits(spark, k).select("ordinal", "pos", "orbit")
    rows = classify(sets, k).select("ordinal", F.transform("perm", lambda i: F.get("nodes", i)).alias("own"))
    own = rows.select("ordinal", F.posexplode("own").alias("pos", "node"), "own").join(F.broadcast(place), ["ordinal", "pos"])
    name = F.col("orbit") if by_orbit else F.col("ordinal")
    links = catalogs.nonbridges(spark, k)
    if symmetric:
        links = links.union(links.select("ordinal", F.col("d").alias("c"), F.col("c").alias("d")))
    near = links.groupBy("ordinal", F.col("c").alias("pos")).agg(F.sort_array(F.collect_list("d")).alias("to"))
    met = own.join(F.broadcast(near), ["ordinal", "pos"], "left")
    seen = met.select("node", name.alias("id"), F.transform("to", lambda d: F.get("own", d)).alias("met"))
    pairs = seen.select("node", "id", F.explode_outer("met").alias("other"))
    # a row per node, id and neighbour first, so that no group gathers more than a node's neighbours
    every = seen.groupBy("node", "id").agg(F.count("*").alias("count"))
    near_of = (
        pairs.filter("other is not null")
        .select("node", "id", "other")
        .distinct()
        .groupBy("node", "id")
        .agg(F.sort_array(F.collect_list("other")).alias("neighbours"))
    )
    return every.join(near_of, ["node", "id"], "left").withColumn(
        "neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>"))
    )


def neighbour_distribution(walk: DataFrame, k: int) -> DataFrame:
    """(before, after, count): graphlets of successive samples (chain, step, nodes, ordinal) of a chain that share k - 1 nodes."""
    order = Window.partitionBy("chain").orderBy("step")
    pairs = walk.select(
        F.lag("nodes").over(order).alias("old"), F.lag("ordinal").over(order).alias("before"), "nodes", F.col("ordinal").alias("after")
    )
    close = pairs.filter(F.size(F.array_intersect("old", "nodes")) == k - 1)
    return close.groupBy("before", "after").agg(F.count("*").alias("count"))


def batch_statistics(batches: DataFrame, k: int, confidence: float = 0.95) -> DataFrame:
    """From counts (batch, ordinal, count): ordinal, mean, batches, half-width of the two-sided interval and relative width. The
    interval is Student's t on the batches' counts, absent graphlets counting 0."""
    from ..functions.numbers import t_quantile

    n = batches.select("batch").distinct().count()
    own = catalogs.canon(batches.sparkSession, k).filter("connected").select("ordinal")
    summed = batches.groupBy("ordinal").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
    mean = F.coalesce(F.col("s"), F.lit(0)) / n
    spread = F.coalesce(F.col("q"), F.lit(0)) - n * mean * mean
    half = F.sqrt(F.greatest(spread, F.lit(0.0)) / max(1, n - 1)) * t_quantile(confidence, max(1, n - 1)) / n**0.5
    return own.join(summed, "ordinal", "left").select(
        "ordinal",
        F.round(mean, 9).alias("mean"),
        F.lit(n).alias("batches"),
        F.round(half, 9).alias("half_width"),
        F.round(F.when(mean > 0, half / mean).otherwise(0.0), 9).alias("relative"),
    )
