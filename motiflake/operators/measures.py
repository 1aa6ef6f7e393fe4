"""Measures of nodes, communities, alignments and pairs of graphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphlets
from ..functions.numbers import hypergeometric_tail, ks_tail
from ..plans import catalogs
from ..plans.stash import stash
from .aggregate import classify
from .enumerate import cliques, triangles
from .normalize import both_ways, degrees, nodes

# ---- nodes


def clustering(edges: DataFrame) -> DataFrame:
    """(id, deg, links, coefficient): edges among a node's neighbours, and their share of all pairs."""
    found = triangles(edges)
    at = found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    own = degrees(edges).join(at, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    pairs = F.col("deg") * (F.col("deg") - 1) / 2
    return own.withColumn("coefficient", F.round(F.when(F.col("deg") > 1, F.col("links") / pairs).otherwise(0.0), 9))


def exact_orbits(edges: DataFrame) -> DataFrame:
    """(node, o0 ... o3): the orbits of graphs of two and three nodes by closed forms: degrees, paths by their end and middle,
    and triangles."""
    own = clustering(edges).select("id", "deg", "links")
    far = both_ways(edges).join(own.select(F.col("id").alias("v"), F.col("deg").alias("dv")), "v")
    reach = far.groupBy(F.col("u").alias("id")).agg(F.sum(F.col("dv") - 1).alias("steps"))
    return own.join(reach, "id").select(
        F.col("id").alias("node"),
        F.col("deg").alias("o0"),
        (F.col("steps") - 2 * F.col("links")).alias("o1"),
        (F.col("deg") * (F.col("deg") - 1) / 2 - F.col("links")).cast("long").alias("o2"),
        F.col("links").alias("o3"),
    )


def exact_orbits4(edges: DataFrame) -> DataFrame:
    """(node, o0 ... o14): orbits of graphs of two to four nodes by closed forms, without listing sets of four but for cliques.

    Each form counts subgraphs that need not be induced, from degrees, triangles of nodes and edges, and common neighbours of
    pairs; what it counts in denser graphs too is taken off, clique first. A hub costs its wedges, which are counted per pair
    of ends as they are made, and triangles grow along the degree order.
    """
    both = stash(both_ways(edges))
    tri = stash(triangles(edges))
    deg = both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"))
    at = tri.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    node = stash(deg.join(at, "id", "left").select("id", "d", F.coalesce("t", F.lit(0)).cast("long").alias("t")))
    pair = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    edge = tri.select(F.explode(F.array(pair("a", "b"), pair("a", "c"), pair("b", "c"))).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("te"))
    edge = stash(edge)
    own = lambda *names: node.select(*(F.col(c).alias(n) for c, n in zip(("id", "d", "t"), names)))
    # by edge: the other end's degree and triangles, and the edge's own triangles
    held = both.join(edge.select(F.col("src").alias("u"), F.col("dst").alias("v"), "te").union(edge.select("dst", "src", "te")), ["u", "v"], "left")
    held = held.na.fill(0, ["te"]).join(own("v", "dv", "tv"), "v").join(own("u", "du", "tu"), "u")
    per = held.groupBy("u", "du", "tu").agg(
        F.sum(F.col("dv") - 1).alias("steps"),
        F.sum(F.col("te") * (F.col("te") - 1) / 2).cast("long").alias("fans"),
        F.sum(F.col("tv") - F.col("te")).alias("tails"),
        F.sum((F.col("dv") - 1) * (F.col("dv") - 2) / 2).cast("long").alias("forks"),
        F.sum((F.col("du") - 1) * (F.col("dv") - 1) - F.col("te")).alias("middles"),
    )
    # paths of three edges from a node: one edge, then the wedges of what it leads to
    reach = held.groupBy("u").agg(F.sum(F.col("dv") - 1).alias("s"))
    far = both.join(reach.select(F.col("u").alias("v"), F.col("s")), "v").groupBy("u").agg(F.sum("s").alias("ahead"))
    # by triangle: degrees of the two others, and triangles on the edge between them
    sides = tri.select(F.explode(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("src"), F.col(z).alias("dst")) for x, y, z in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))))).alias("s")).select("s.*")
    sides = sides.join(edge, ["src", "dst"]).join(own("src", "d1", "t1"), "src").join(own("dst", "d2", "t2"), "dst")
    of_tri = sides.groupBy("u").agg(F.sum(F.col("te") - 1).alias("tips"), F.sum(F.col("d1") + F.col("d2") - 4).alias("legs"))
    # by pair of nodes two steps apart: how many ways; a middle's wedges come from its own list
    lists = both.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("near"))
    wedge = lists.select("near", F.posexplode("near").alias("i", "x")).select("x", F.explode(F.slice("near", F.col("i") + 2, F.size("near"))).alias("y"))
    ways = wedge.groupBy("x", "y").agg(F.count("*").alias("c")).filter("c > 1").withColumn("n", (F.col("c") * (F.col("c") - 1) / 2).cast("long"))
    rounds = ways.select(F.explode(F.array("x", "y")).alias("u"), "n").groupBy("u").agg(F.sum("n").alias("rounds"))
    four = cliques(edges, 4).select(F.explode("nodes").alias("u")).groupBy("u").agg(F.count("*").alias("o14"))
    row = per.join(far, "u").join(of_tri, "u", "left").join(rounds, "u", "left").join(four, "u", "left").na.fill(0)
    d, c = F.col("du"), F.col
    steps = (
        ("o0", d), ("o1", c("steps") - 2 * c("tu")), ("o2", (d * (d - 1) / 2).cast("long") - c("tu")), ("o3", c("tu")),
        ("o13", c("fans") - 3 * c("o14")), ("o12", c("tips") - 3 * c("o14")),
        ("o8", c("rounds") - c("o12") - c("o13") - 3 * c("o14")),
        ("o11", c("tu") * (d - 2) - 2 * c("o13") - 3 * c("o14")),
        ("o10", c("legs") - 2 * c("o12") - 2 * c("o13") - 6 * c("o14")),
        ("o9", c("tails") - 2 * c("o12") - 3 * c("o14")),
        ("o7", (d * (d - 1) * (d - 2) / 6).cast("long") - c("o11") - c("o13") - c("o14")),
        ("o6", c("forks") - c("o9") - c("o10") - 2 * c("o12") - c("o13") - 3 * c("o14")),
        ("o5", c("middles") - 2 * c("o8") - 2 * c("o11") - c("o10") - 4 * c("o13") - 2 * c("o12") - 6 * c("o14")),
        # ahead counts steps back to the start's neighbour's other edges; those that return to the start or close a triangle go
        ("o4", c("ahead") - d * (d - 1) - 2 * c("tu") - 2 * c("o8") - 2 * c("o9") - c("o10") - 2 * c("o13") - 4 * c("o12") - 6 * c("o14")),
    )
    for name, form in steps:
        row = row.withColumn(name, form.cast("long"))
    return row.select(F.col("u").alias("node"), *(f"o{i}" for i in range(15)))


def graphlet_counts4(orbits: DataFrame) -> DataFrame:
    """(ordinal, count) of connected graphs of four nodes from the rows of :func:`exact_orbits4`: each graph's orbit over how
    many of its nodes are in it."""
    parts = ((4, 2), (7, 1), (8, 4), (11, 1), (13, 2), (14, 4))
    whole = catalogs.canon(orbits.sparkSession, 4).filter("connected").select("ordinal", "m", "stars")
    # edges and the most in a star tell the six graphs apart
    named = {(3, 0): 4, (3, 1): 7, (4, 0): 8, (4, 1): 11, (5, 2): 13, (6, 4): 14}
    share = dict(parts)
    sums = orbits.agg(*(F.sum(f"o{i}").alias(f"s{i}") for i, _ in parts))
    kinds = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(st).alias("stars"), (F.coalesce(f"s{i}", F.lit(0)) / share[i]).cast("long").alias("count")) for (m, st), i in named.items()))
    return whole.join(F.broadcast(sums.select(F.explode(kinds).alias("x")).select("x.*")), ["m", "stars"]).select("ordinal", "count")


# ---- communities


def triple_communities(edges: DataFrame) -> DataFrame:
    """What :func:`.aggregate.communities` gives of all connected sets of three nodes by graphlet, symmetric. Counts are closed forms
    over degrees and triangles, and only triangles have edges that are no bridges, so that paths are not listed."""
    whole = graphlets.catalog(3)
    path, triangle = (next(o for o, c in enumerate(whole.connected) if c and len(whole.edges(o)) == m) for m in (2, 3))
    found = stash(triangles(edges))
    met = found.select(F.explode(F.array("a", "b", "c")).alias("node"), F.array("a", "b", "c").alias("set"))
    pairs = met.select("node", F.explode("set").alias("other")).filter("node <> other")
    near = pairs.groupBy("node").agg((F.count("*") / 2).cast("long").alias("links"), F.sort_array(F.collect_set("other")).alias("neighbours"))
    deg = degrees(edges).withColumnRenamed("id", "node")
    far = both_ways(edges).join(deg.select(F.col("node").alias("v"), F.col("deg").alias("dv")), "v")
    steps = far.groupBy(F.col("u").alias("node")).agg(F.sum(F.col("dv") - 1).alias("steps"))
    own = deg.join(steps, "node").join(near, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    # a node is the middle of pairs of its edges and an end of its neighbours' other edges
    paths = (F.col("deg") * (F.col("deg") - 1) / 2 + F.col("steps") - 3 * F.col("links")).cast("long")
    none = F.array().cast("array<bigint>")
    both = F.array(F.struct(F.lit(path).alias("id"), paths.alias("count"), none.alias("neighbours")), F.struct(F.lit(triangle).alias("id"), F.col("links").cast("long").alias("count"), F.coalesce("neighbours", none).alias("neighbours")))
    return own.select("node", F.explode(both).alias("x")).select("node", "x.*").filter("count > 0")


def community_scores(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Per community of membership(node, community): nodes, edges inside, edges out, densities within and across, conductance, and
    the density score of edges inside times density. Nodes of edges without a community are outside all."""
    own = membership.select(F.col("node").alias("src"), F.col("community").alias("a"))
    other = membership.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    told = edges.select("src", "dst").join(own, "src", "left").join(other, "dst", "left")
    inside = told.filter("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("inside"))
    cross = told.filter("a is null or b is null or a <> b")
    ends = cross.select(F.explode(F.array("a", "b")).alias("community")).filter("community is not null")
    out = ends.groupBy("community").agg(F.count("*").alias("outside"))
    size = membership.groupBy("community").agg(F.count("*").alias("n"))
    whole = nodes(edges).agg(F.count("*").alias("all"))
    joined = size.join(inside, "community", "left").join(out, "community", "left").join(F.broadcast(whole)).na.fill(0, ["inside", "outside"])
    pairs = F.col("n") * (F.col("n") - 1) / 2
    intra = F.when(F.col("n") > 1, F.col("inside") / pairs).otherwise(0.0)
    across = F.col("n") * (F.col("all") - F.col("n"))
    ends_all = 2 * F.col("inside") + F.col("outside")
    r = lambda c: F.round(c, 9)
    return joined.select(
        "community", "n", "inside", "outside",
        r(intra).alias("intra_density"),
        r(F.when(across > 0, F.col("outside") / across).otherwise(0.0)).alias("inter_density"),
        r(F.when(ends_all > 0, F.col("outside") / ends_all).otherwise(0.0)).alias("conductance"),
        r(F.col("inside") * intra).alias("score"),
    )


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the share of edges inside communities over what degrees alone would give."""
    told = community_scores(edges, membership)
    m = edges.agg(F.count("*").alias("m"))
    part = told.join(F.broadcast(m)).select(
        (F.col("inside") / F.col("m") - F.pow((2 * F.col("inside") + F.col("outside")) / (2 * F.col("m")), 2)).alias("q")
    )
    return part.agg(F.round(F.sum("q"), 9).alias("modularity"))


# ---- alignments


def alignment_scores(edges1: DataFrame, edges2: DataFrame, alignment: DataFrame) -> DataFrame:
    """One row for an alignment (n1, n2): edges that it keeps, edges of each graph among aligned nodes, and EC1, EC2, S3."""
    one = lambda c, d: alignment.select(F.col("n1").alias(c), F.col("n2").alias(d))
    mapped = edges1.select("src", "dst").join(one("src", "x"), "src").join(one("dst", "y"), "dst")
    images = mapped.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
    back = alignment.select("n2").distinct()
    two = edges2.select("src", "dst").join(back, F.col("src") == F.col("n2"), "left_semi").join(back, F.col("dst") == F.col("n2"), "left_semi")
    kept = images.join(two, ["src", "dst"], "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    row = count(kept, "ea").join(F.broadcast(count(images, "e1"))).join(F.broadcast(count(two, "e2")))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 9)
    ea, e1, e2 = F.col("ea"), F.col("e1"), F.col("e2")
    return row.select("ea", "e1", "e2", share(ea, e1).alias("ec1"), share(ea, e2).alias("ec2"), share(ea, e1 + e2 - ea).alias("s3"))


def degree_similarity(edges1: DataFrame, edges2: DataFrame) -> DataFrame:
    """(deg1, deg2, similarity): how alike nodes of such degrees are. It depends on degrees alone, so it is told for the different
    degrees of either graph, not for all pairs of nodes; join it with nodes' degrees."""
    d1 = degrees(edges1).select(F.col("deg").alias("deg1")).distinct()
    d2 = degrees(edges2).select(F.col("deg").alias("deg2")).distinct()
    listed = d2.agg(F.sort_array(F.collect_list("deg2")).alias("all"))  # different degrees, at most the root of twice m
    top = d1.agg(F.max("deg1").alias("m1")).join(F.broadcast(listed.select(F.array_max("all").alias("m2"))))
    pairs = d1.join(F.broadcast(listed)).select("deg1", F.explode("all").alias("deg2")).join(F.broadcast(top))
    return pairs.select("deg1", "deg2", F.round((F.col("deg1") + F.col("deg2")) / (F.col("m1") + F.col("m2")), 9).alias("similarity"))


def orbit_weights(dependencies: list[int]) -> list[float]:
    """1 - ln(o) / ln(n) for orbits that o of all n orbits depend on."""
    return [1 - float(np.log(o) / np.log(len(dependencies))) for o in dependencies]


def _similarity(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarities of all rows of x with all rows of y."""
    total = np.zeros((len(x), len(y)))
    for j in range(len(w)):
        p, q = x[:, j][:, None], y[:, j][None, :]
        total += w[j] * np.abs(np.log(p + 1) - np.log(q + 1)) / np.log(np.maximum(p, q) + 2)
    return np.round(1 - total / w.sum(), 9)


def top_pairs(one: DataFrame, two: DataFrame, weights: list[float], n: int, block: int = 1024) -> DataFrame:
    """(n1, n2, similarity): the n most similar pairs of nodes of vectors (node, vector), ties by node ids.

    Nodes of equal vectors are one class, which needs its n smallest ids at most. Classes are ranged by the count of weightiest
    orbit into blocks. Equal classes, and then blocks of one range, give a bound that the n-th best pair reaches; of the
    other pairs of blocks only those are compared whose ranges allow that much.
    """
    w = np.array(weights)
    lead = int(w.argmax())
    spark = one.sparkSession

    def classes(df: DataFrame) -> DataFrame:
        # a class's n smallest ids: those of each part of it, and then of these
        rows = df.select("node", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("node"), F.lit(64)).alias("part"))
        first = F.row_number().over(Window.partitionBy("vector", "part").orderBy("node"))
        few = rows.withColumn("at", first).filter(F.col("at") <= n)
        return few.groupBy("vector").agg(F.slice(F.sort_array(F.collect_list("node")), 1, n).alias("ids"))

    left, right = stash(classes(one)), stash(classes(two))
    value = F.get("vector", F.lit(lead))
    cuts = left.union(right).select(value.alias("v"))
    count = max(1, -(-max(left.count(), right.count()) // block))
    marks = sorted(set(cuts.agg(F.percentile_approx("v", [i / count for i in range(1, count)], 10_000).alias("p")).first()["p"] or [])) if count > 1 else []

    def ranged(df: DataFrame, name: str) -> DataFrame:
        place = F.size(F.filter(F.array(*map(F.lit, marks)).cast("array<double>"), lambda m: m <= value))
        # a range of many classes is dealt out, so that no task gets more than about a block of each side
        rows = df.select(place.alias("range"), value.alias("v"), F.struct("vector", "ids").alias("row"))
        sizes = rows.groupBy("range").agg(F.ceil(F.count("*") / block).alias("parts"))
        dealt = rows.join(F.broadcast(sizes), "range").withColumn("part", F.pmod(F.xxhash64("row.vector"), F.col("parts")))
        packed = dealt.groupBy("range", "part").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.collect_list("row").alias("rows"))
        return packed.select(*(F.col(c).alias(f"{name}_{c}") for c in packed.columns))

    l, r = stash(ranged(left, "l")), stash(ranged(right, "r"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(value):
            rows = value.values
            vectors = rows.field("vector")
            return rows.field("ids"), vectors.flatten().to_numpy().reshape(len(vectors), -1)

        for batch in batches:
            for i in range(batch.num_rows):
                (a, x), (b, y) = read(batch.column("l_rows")[i]), read(batch.column("r_rows")[i])
                found = _similarity(w, x, y)
                flat = found.ravel()
                # the n best pairs of classes by what they reach and their first ids have the n best pairs of nodes among them
                near = np.flatnonzero(flat >= np.partition(flat, len(flat) - n)[len(flat) - n]) if len(flat) > n else np.arange(len(flat))
                first_a, first_b = (np.array([x[0].as_py() for x in ids], np.int64) for ids in (a, b))
                order = near[np.lexsort((first_b[near % len(y)], first_a[near // len(y)], -flat[near]))[:n]]
                out: list[tuple] = []
                for p in order.tolist():
                    # pairs of two lists in order of the first and then the second: n of them are enough
                    own = ((-flat[p], u, v) for u in a[p // len(y)].as_py() for v in b[p % len(y)].as_py())
                    out += islice(own, n)
                out = sorted(out)[:n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([u for _, u, _ in out], pa.int64()), pa.array([v for _, _, v in out], pa.int64()), pa.array([-s for s, _, _ in out], pa.float64())],
                    ["n1", "n2", "similarity"],
                )

    schema = "n1 long, n2 long, similarity double"
    top = lambda df: df.orderBy(F.desc("similarity"), "n1", "n2").limit(n)
    near = l.join(r, F.col("l_range") == F.col("r_range")).select("l_rows", "r_rows", "l_range", "l_part", "r_part")
    spread = lambda df: df.repartition("l_range", "l_part", "r_part").select("l_rows", "r_rows")
    first = stash(top(spread(near).mapInArrow(best, schema)))
    found = first.count()
    reached = first.agg(F.min("similarity").alias("s")).first()["s"] if found == n else -1.0
    # ranges are few; of each pair of others the most that two vectors in them can reach
    meta = lambda df, s: df.groupBy(f"{s}_range").agg(F.min(f"{s}_low").alias(f"{s}_low"), F.max(f"{s}_high").alias(f"{s}_high")).collect()
    open_pairs = []
    rights = meta(r, "r")
    for p in meta(l, "l"):
        for q in rights:
            if p["l_range"] != q["r_range"]:
                low, high = (p["l_high"], q["r_low"]) if p["l_high"] < q["r_low"] else (q["r_high"], p["l_low"])
                gap = w[lead] * abs(np.log(high + 1) - np.log(low + 1)) / np.log(max(p["l_high"], q["r_high"]) + 2) if high > low else 0.0
                if round(1 - gap / w.sum(), 9) >= reached:
                    open_pairs.append((p["l_range"], q["r_range"]))
    if not open_pairs:
        return first
    pairs = spark.createDataFrame(open_pairs, "l_range int, r_range int")
    more = l.join(F.broadcast(pairs), "l_range").join(r, "r_range").select("l_rows", "r_rows", "l_range", "l_part", "r_part")
    return top(first.union(spread(more).mapInArrow(best, schema)))


# ---- prediction


def predict(sets: DataFrame, edges: DataFrame, k: int, orbit_a: int, orbit_b: int, by_order: bool = True) -> DataFrame:
    """(u, v, score): pairs of nodes without an edge that an edge would put into the two orbits, scored by the motifs of each
    set and the inverse degrees of its other nodes."""
    motifs = catalogs.pair_motifs(sets.sparkSession, k, orbit_a, orbit_b, by_order)
    rows = classify(sets, k).select("ordinal", F.transform("perm", lambda p: F.get("nodes", p)).alias("own")).join(F.broadcast(motifs), "ordinal")
    pick = lambda i: F.get("own", F.col(i))
    others = F.filter("own", lambda x, p: (p != F.col("i")) & (p != F.col("j")))
    told = rows.select(F.least(pick("i"), pick("j")).alias("u"), F.greatest(pick("i"), pick("j")).alias("v"), F.explode(others).alias("x"), "motifs")
    # motifs are counted per pair and other node before degrees come in
    counted = told.groupBy("u", "v", "x").agg(F.sum("motifs").alias("n"))
    deg = degrees(edges).select(F.col("id").alias("x"), (1 / F.col("deg")).alias("inv"))
    scored = counted.join(deg, "x").groupBy("u", "v").agg(F.round(F.sum(F.col("n") * F.col("inv")), 6).alias("score"))
    return scored.filter("score <> 0")


def top_predictions(scored: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The n best-scored pairs that are not among known edges, ties by ids."""
    new = scored.join(known.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti")
    return new.orderBy(F.desc("score"), "u", "v").limit(n)


def hold_out(scored: DataFrame, train: DataFrame, test: DataFrame, n: int) -> DataFrame:
    """One row: how many of the n best pairs outside train are in test."""
    best = top_predictions(scored, train, n)
    hit = best.join(test.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_semi").agg(F.count("*").alias("hits"))
    return best.agg(F.count("*").alias("predicted")).join(F.broadcast(hit))


def ranking_quality(rows: DataFrame) -> DataFrame:
    """One row for rows (score, label 0 or 1): area under the ROC curve (ties half), average precision, NDCG. Rows are counted
    per different score first; what is ranked is those counts."""
    per = rows.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("q"))
    total = per.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    from .normalize import numbered

    # running sums in two levels: within ranges of scores, and over the ranges' totals
    placed = numbered(per.withColumn("neg", -F.col("score")), "neg", into="no").withColumn("r", F.floor(F.col("no") / 4096))
    within = Window.partitionBy("r").orderBy("no")
    sums = placed.groupBy("r").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    ahead = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row per 4096 scores
    before = sums.select("r", F.coalesce(F.sum("sp").over(ahead), F.lit(0.0)).alias("bp"), F.coalesce(F.sum("sq").over(ahead), F.lit(0.0)).alias("bq"))
    run = placed.join(F.broadcast(before), "r").select(
        "p", "q", (F.sum("p").over(within) + F.col("bp")).alias("tp"), (F.sum("q").over(within) + F.col("bq")).alias("fp")
    )
    parts = run.join(F.broadcast(total)).select(
        (F.col("q") * (F.col("tp") - F.col("p") / 2) / (F.col("all_p") * F.col("all_q"))).alias("roc"),
        (F.col("p") / F.col("all_p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    return parts.agg(F.round(F.sum("roc"), 9).alias("auroc"), F.round(F.sum("ap"), 9).alias("average_precision"))


def enrichment(found: DataFrame, annotations: DataFrame) -> DataFrame:
    """(cluster, term, hits, size, carriers, total, p_value): how many nodes of each of found (cluster, nodes) carry a term of
    annotations (node, term), and the chance of that many or more among as many nodes drawn. Terms without a hit are left out."""
    own = annotations.select("node", "term").distinct()
    at = found.select("cluster", F.explode("nodes").alias("node")).distinct()
    known = at.join(own.select("node").distinct(), "node", "left_semi")
    size = known.groupBy("cluster").agg(F.count("*").alias("size"))
    carriers = own.groupBy("term").agg(F.count("*").alias("carriers"))
    total = own.agg(F.countDistinct("node").alias("total"))
    hits = known.join(own, "node").groupBy("cluster", "term").agg(F.count("*").alias("hits"))

    @F.pandas_udf("double")
    def tail(t: pd.Series, c: pd.Series, s: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([hypergeometric_tail(int(x), int(y), int(z), int(w)) for x, y, z, w in zip(t, c, s, h)])

    rows = hits.join(size, "cluster").join(carriers, "term").join(F.broadcast(total))
    return rows.withColumn("p_value", F.round(tail("total", "carriers", "size", "hits"), 9))


# ---- two graphs


def count_objectives(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row for counts (ordinal, count) of two graphs: Euclidean distance, 1 - cosine, and the mean relative difference."""
    a = one.select("ordinal", F.col("count").cast("double").alias("a"))
    b = two.select("ordinal", F.col("count").cast("double").alias("b"))
    both = a.join(b, "ordinal", "full_outer").na.fill(0.0)
    dot, na, nb = F.sum(F.col("a") * F.col("b")), F.sum(F.col("a") * F.col("a")), F.sum(F.col("b") * F.col("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return both.agg(
        F.round(F.sqrt(F.sum(gap * gap)), 6).alias("euclidean"),
        F.round(1 - dot / F.sqrt(na * nb), 9).alias("kernel"),
        F.round(F.avg(F.when(F.greatest("a", "b") > 0, gap / F.greatest("a", "b")).otherwise(0.0)), 9).alias("senatorial"),
    )


def distribution_distance(one: DataFrame, two: DataFrame, value: str) -> DataFrame:
    """One row for (value, nodes) of two graphs: the largest gap of their cumulative shares, the chance of such a gap, and the
    Euclidean distance of shares. The values are different ones, such as degrees."""
    both = one.select(value, F.col("nodes").cast("double").alias("a")).join(two.select(value, F.col("nodes").cast("double").alias("b")), value, "full_outer").na.fill(0.0, ["a", "b"])
    whole = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    shares = both.join(F.broadcast(whole)).select(value, (F.col("a") / F.col("na")).alias("a"), (F.col("b") / F.col("nb")).alias("b"), "na", "nb")
    run = Window.orderBy(value)  # one row per different value
    gaps = shares.select(F.abs(F.sum("a").over(run) - F.sum("b").over(run)).alias("gap"), F.pow(F.col("a") - F.col("b"), 2).alias("sq"), "na", "nb")
    found = gaps.agg(F.round(F.max("gap"), 9).alias("ks"), F.round(F.sqrt(F.sum("sq")), 9).alias("euclidean"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    row = found.first()
    n = row["na"] * row["nb"] / (row["na"] + row["nb"]) if row["na"] and row["nb"] else 0.0
    lam = (n**0.5 + 0.12 + 0.11 / n**0.5) * row["ks"] if n else 0.0
    return found.select("ks", F.lit(round(ks_tail(lam), 9)).alias("p_value"), "euclidean")


def hamming_objective(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """One row: how far counts (ordinal, count) are in edge flips: each graphlet's surplus in one times its mean distance to
    those short of it."""
    both = one.select("ordinal", F.col("count").cast("double").alias("a")).join(two.select("ordinal", F.col("count").cast("double").alias("b")), "ordinal", "full_outer").na.fill(0.0)
    gap = both.select("ordinal", (F.col("a") - F.col("b")).alias("gap")).filter("gap <> 0")
    far = catalogs.hamming(one.sparkSession, k)
    more = gap.filter("gap > 0").select(F.col("ordinal").alias("c1"), F.col("gap").alias("m"))
    less = gap.filter("gap < 0").select(F.col("ordinal").alias("c2"), (-F.col("gap")).alias("l"))
    short = less.agg(F.sum("l").alias("all"))
    met = far.join(more, "c1").join(less, "c2").join(F.broadcast(short))
    return met.agg(F.round(F.coalesce(F.sum(F.col("m") * F.col("l") / F.col("all") * F.col("dist")), F.lit(0.0)), 6).alias("hamming"))


def quartiles(values: DataFrame, column: str) -> DataFrame:
    """One row: n, quartiles, and the width of histogram bins, twice the quartiles' range over the cube root of n."""
    q = F.percentile(F.col(column), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = values.agg(F.count(column).alias("n"), q.alias("q"))
    at = lambda i: F.get("q", F.lit(i))
    return found.select("n", at(0).alias("q1"), at(1).alias("median"), at(2).alias("q3"), F.round(2 * (at(2) - at(0)) / F.cbrt("n"), 9).alias("bin_width"))


