"""The catalogs of :mod:`motiflake.functions.graphlets` as tables. Their sizes depend on k alone, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import graphlets


def canon(spark: SparkSession, k: int, directed: bool = False) -> DataFrame:
    """A row per canonical graph: ordinal, gint, connected, number of edges, edges as text, orbits, most in one star."""
    whole = graphlets.catalog(k, directed)
    rows = []
    for o, gint in enumerate(whole.gints):
        edges = whole.edges(o)
        stars = sum(len(n) == k - 1 for n in graphlets.neighbours(gint, k, directed))
        rows.append((o, gint, whole.connected[o], len(edges), " ".join(f"{i},{j}" for i, j in edges), whole.orbits[o], stars))
    return spark.createDataFrame(
        rows, "ordinal int, gint long, connected boolean, m int, edges string, orbits array<int>, stars int"
    ).coalesce(1)


def canon_map(spark: SparkSession, k: int, directed: bool = False) -> DataFrame:
    """Every number of k nodes: gint, ordinal, perm. Up to 15 node pairs, 32768 rows."""
    ordinal, perm, _ = graphlets.canonical_map(k, directed)
    rows = [(g, int(ordinal[g]), perm[g].tolist()) for g in range(len(ordinal))]
    return spark.createDataFrame(rows, "gint long, ordinal int, perm array<int>").coalesce(1)


def orbits(spark: SparkSession, k: int, directed: bool = False) -> DataFrame:
    """A row per canonical graph and node: ordinal, pos, orbit, connected_orbit (its place among connected ones, else null)."""
    whole = graphlets.catalog(k, directed)
    place = {}
    if not directed:
        place = {o: i for i, o in enumerate(graphlets.connected_orbits(k))}
    rows = [(o, p, x, place.get(x)) for o, orbit in enumerate(whole.orbits) for p, x in enumerate(orbit)]
    return spark.createDataFrame(rows, "ordinal int, pos int, orbit int, connected_orbit int").coalesce(1)


def alphas(spark: SparkSession, k: int, method: str) -> DataFrame:
    rows = list(enumerate(graphlets.alphas(k, method)))
    return spark.createDataFrame(rows, "ordinal int, alpha long").coalesce(1)


def subcanon(spark: SparkSession, k: int) -> DataFrame:
    """(ordinal, removed node, ordinal of what is left)."""
    rows = [(o, k - 1 - i, s) for o, subs in enumerate(graphlets.subcanonicals(k)) for i, s in enumerate(subs)]
    return spark.createDataFrame(rows, "ordinal int, removed int, sub_ordinal int").coalesce(1)


def hamming(spark: SparkSession, k: int) -> DataFrame:
    table = graphlets.hamming(k)
    rows = [(a, b, int(d)) for a, row in enumerate(table) for b, d in enumerate(row)]
    return spark.createDataFrame(rows, "c1 int, c2 int, dist int").coalesce(1)


def hamming_neighbours(spark: SparkSession, k: int, distance: int) -> DataFrame:
    """(c1, c2): ordinals whose graphs are that many edge flips apart at least."""
    return hamming(spark, k).filter(f"dist = {int(distance)}").select("c1", "c2")


def map_differences(one: DataFrame, two: DataFrame, places: DataFrame) -> DataFrame:
    """(gint): numbers that two canonical maps (gint, ordinal, perm) take to different graphs, or whose nodes they take to different
    orbits of places (ordinal, pos, orbit); maps that differ by automorphisms alone have none."""
    from pyspark.sql import functions as F

    orbit = places.groupBy("ordinal").agg(F.sort_array(F.collect_list(F.struct("pos", "orbit"))).alias("o"))
    # a map's perm says which node stands in each canonical place; node by node that is the orbit it lands in
    lands = lambda c: F.sort_array(F.transform(F.col(f"{c}.own"), lambda n, i: F.struct(n.alias("node"), F.get(F.col(f"{c}.o"), i).alias("orbit"))))
    rows = lambda m, name: m.join(F.broadcast(orbit), "ordinal").select(
        "gint", F.struct("ordinal", F.col("perm").alias("own"), F.transform("o", lambda x: x["orbit"]).alias("o")).alias(name)
    )
    both = rows(one, "a").join(rows(two, "b"), "gint", "full_outer")
    same = (F.col("a.ordinal") == F.col("b.ordinal")) & (lands("a") == lands("b"))
    return both.filter(~F.coalesce(same, F.lit(False))).select("gint")


def crosswalk(spark: SparkSession, k: int) -> DataFrame:
    rows = graphlets.crosswalk(k)
    schema = ", ".join(f"{c} long" for c in rows[0])
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1)


def nonbridges(spark: SparkSession, k: int) -> DataFrame:
    """Edges (c, d), c < d, of connected canonical graphs that are not bridges: ordinal, c, d."""
    whole = graphlets.catalog(k)
    rows = [
        (o, i, j)
        for o, gint in enumerate(whole.gints)
        if whole.connected[o]
        for i, j in whole.edges(o)
        if not graphlets.is_bridge(gint, k, (i, j))
    ]
    return spark.createDataFrame(rows, "ordinal int, c int, d int").coalesce(1)


def pair_motifs(spark: SparkSession, k: int, orbit_a: int, orbit_b: int, by_order: bool = True) -> DataFrame:
    rows = [(o, i, j, n) for (o, i, j), n in graphlets.pair_motifs(k, orbit_a, orbit_b, by_order).items()]
    return spark.createDataFrame(rows, "ordinal int, i int, j int, motifs long").coalesce(1)


def minimal_chains(spark: SparkSession, k: int) -> DataFrame:
    """For every canonical graph the chain of smallest ordinals that removing nodes gives: (ordinal, k, chain_ordinal)."""
    rows = [(o, n, c) for o in range(len(graphlets.canonical_numbers(k))) for n, c in graphlets.minimal_chain(k, o)]
    return spark.createDataFrame(rows, "ordinal int, chain_k int, chain_ordinal int").coalesce(1)


def directed_totals(spark: SparkSession) -> DataFrame:
    """Numbers of directed canonical graphs by k and by number of arcs, summed by k."""
    from pyspark.sql import functions as F

    rows = []
    for k in (3, 4):
        whole = graphlets.catalog(k, True)
        rows += [(k, len(whole.edges(o))) for o in range(len(whole.gints))]
    by_arcs = spark.createDataFrame(rows, "k int, arcs int").groupBy("k", "arcs").agg(F.count("*").alias("n"))
    return by_arcs.groupBy("k").agg(F.sum("n").alias("canonicals"), F.count("*").alias("arc_counts"))


def report(spark: SparkSession, k: int) -> DataFrame:
    """A line per ordinal: its orbits, and whether it is connected."""
    from pyspark.sql import functions as F

    own = canon(spark, k).select("ordinal", "connected", "gint")
    return own.join(
        orbits(spark, k).groupBy("ordinal").agg(F.concat_ws(" ", F.sort_array(F.collect_set("orbit")).cast("array<string>")).alias("orbits")),
        "ordinal",
    )


def dot(spark: SparkSession, k: int) -> DataFrame:
    """A drawing of each canonical graph as DOT text."""
    whole = graphlets.catalog(k)
    rows = []
    for o in range(len(whole.gints)):
        lines = [f'{i} [label="{i}:{x}"];' for i, x in enumerate(whole.orbits[o])] + [f"{i} -- {j};" for i, j in whole.edges(o)]
        rows.append((o, f"graph g{o} {{ {' '.join(lines)} }}"))
    return spark.createDataFrame(rows, "ordinal int, dot string").coalesce(1)
