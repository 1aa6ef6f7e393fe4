"""Normal forms of graphs, their simple measures, and graphs made from others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import graphlets
from ..functions.draws import SPAN, draw
from ..plans.stash import stash


def orient(edges: DataFrame) -> DataFrame:
    """Each edge from its smaller to its larger node; loops go. Other columns stay."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return edges.filter("src <> dst").select(*ends, *rest)


def clean(edges: DataFrame) -> DataFrame:
    """Simple graph: oriented, each edge once."""
    return orient(edges.select("src", "dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) for each edge and its reverse."""
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return ends.union(ends.select("v", "u"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, nbrs in order, deg)."""
    near = both_ways(edges).groupBy(F.col("u").alias("id")).agg(F.sort_array(F.collect_set("v")).alias("nbrs"))
    return near.withColumn("deg", F.size("nbrs"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("deg"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("deg").agg(F.count("*").alias("nodes"))


def max_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.max("deg").alias("max_deg"))


def stats(edges: DataFrame) -> DataFrame:
    """n, m and density, from one grouped pass."""
    own = degrees(edges).agg(F.count("*").alias("n"), (F.sum("deg") / 2).cast("long").alias("m"))
    return own.withColumn("density", F.col("m") / (F.col("n") * (F.col("n") - 1) / 2))


def nodes(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("u").alias("id")).distinct()


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among keep(id)."""
    by = lambda end: edges[end] == F.col("id")
    one = edges.join(keep.select("id"), by("src"), "left_semi")
    return one.join(keep.select("id"), one["dst"] == F.col("id"), "left_semi")


def numbered(rows: DataFrame, *key: str, into: str = "no") -> DataFrame:
    """rows with their place in the order of the key, from 0. Places come from range partitions and their sizes, with no
    sort in a single task. The partitioned rows are written first: Spark samples the bounds of ranges anew for each use of
    a plan, and places hold only for one choice of bounds."""
    parts = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    marked = parts.withColumn("__raw", F.monotonically_increasing_id())
    marked = stash(
        marked.withColumn("__part", F.shiftright("__raw", 33)).withColumn("__at", F.col("__raw").bitwiseAND((1 << 33) - 1)).drop("__raw")
    )
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__size"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    begins = sizes.select("__part", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__begin"))
    placed = marked.join(F.broadcast(begins), "__part").withColumn(into, F.col("__begin") + F.col("__at"))
    return placed.drop("__part", "__at", "__begin")


def rank_by_draw(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """rows with n, their number, and place, 0 for the least draw: an order by chance."""
    drawn = rows.withColumn("__draw", draw(*(F.col(k) for k in key), seed))
    placed = numbered(drawn, "__draw", *key, into="place").drop("__draw")
    return placed.join(F.broadcast(placed.agg(F.count("*").alias("n"))))


def random_nodes(edges: DataFrame, share: float, seed: int) -> DataFrame:
    """floor(share * n) nodes by chance."""
    ranked = rank_by_draw(nodes(edges), seed, "id")
    return ranked.filter(F.col("place") < F.floor(F.col("n") * share)).select("id")


def without_node(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter((F.col("src") != node) & (F.col("dst") != node))


def soften(edges: DataFrame, share: float, seed: int) -> DataFrame:
    """Edges that a draw leaves: each goes with probability share."""
    return edges.filter(draw(F.col("src"), F.col("dst"), seed) >= int(share * SPAN))


def complement(edges: DataFrame, most: int = 4096) -> DataFrame:
    """Pairs of nodes without an edge. The answer has about n * n / 2 rows, so graphs over ``most`` nodes are refused."""
    own = nodes(edges)
    n = own.count()
    if n > most:
        raise ValueError(f"the complement of {n} nodes is not a table worth making; at most {most}")
    # every node gets the whole, small list of nodes as an array, and makes its own later pairs
    listed = own.agg(F.sort_array(F.collect_list("id")).alias("all"))
    later = own.join(F.broadcast(listed)).select(
        F.col("id").alias("src"), F.explode(F.filter("all", lambda x: x > F.col("id"))).alias("dst")
    )
    return later.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def split(edges: DataFrame, test_percent: int, seed: int) -> DataFrame:
    """edges with a column part: exactly ceil of test_percent of them are ``test``, by chance, the others ``train``."""
    ranked = rank_by_draw(edges.select("src", "dst"), seed, "src", "dst")
    test = F.col("place") < F.ceil(F.col("n") * test_percent / 100)
    return ranked.select("src", "dst", F.when(test, "test").otherwise("train").alias("part"))


def shuffled(edges: DataFrame, seed: int) -> DataFrame:
    """edges with their place in an order by chance."""
    return rank_by_draw(edges.select("src", "dst"), seed, "src", "dst").select("src", "dst", "place")


def minus_degree_one(edges: DataFrame) -> DataFrame:
    """Nodes with two neighbours or more."""
    return degrees(edges).filter("deg > 1")


def erdos_renyi(spark: SparkSession, n: int, m: int, seed: int) -> DataFrame:
    """m different edges by chance among n nodes: twice as many tries as edges, and as many more as it takes."""
    if m > n * (n - 1) // 4:
        raise ValueError("at most half of all pairs")
    tries = 2 * m + 16
    while True:
        made = spark.range(tries).select(
            "id", (draw(F.col("id"), 0, seed) % n).alias("a"), (draw(F.col("id"), 1, seed) % n).alias("b")
        )
        first = (
            made.filter("a <> b")
            .groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
            .agg(F.min("id").alias("id"))
        )
        if first.count() >= m:
            return first.orderBy("id").limit(m).select("src", "dst")
        tries *= 2


def ring_lattice(spark: SparkSession, n: int, reach: int) -> DataFrame:
    """Each node joined to the reach nodes that follow it on a ring."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("step")
    made = spark.range(n).select(F.col("id").alias("src"), steps)
    return clean(made.select("src", ((F.col("src") + F.col("step")) % n).alias("dst")))


def clique_communities(spark: SparkSession, cliques: int, size: int, bridges: int = 1) -> DataFrame:
    """Cliques in a ring, successive ones joined by some edges."""
    inner = spark.range(cliques * size).select(
        F.col("id").alias("src"),
        F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("other"),
    )
    base = F.floor(F.col("src") / size) * size
    within = inner.select("src", (base + F.col("other")).alias("dst"))
    between = spark.range(cliques).select(
        F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(bridges - 1))).alias("at")
    ).select(
        (F.col("id") * size + F.col("at")).alias("src"), ((F.col("id") + 1) % cliques * size + F.col("at")).alias("dst")
    )
    return clean(within.union(between))


def chained_canonicals(spark: SparkSession, k: int) -> DataFrame:
    """One graph that holds every connected graphlet of k nodes: each in a place of its own, sharing a node with the next."""
    whole = graphlets.catalog(k)
    rows = []
    for rank, o in enumerate(o for o, c in enumerate(whole.connected) if c):
        rows += [(rank * (k - 1) + i, rank * (k - 1) + j) for i, j in whole.edges(o)]
    return spark.createDataFrame(rows, "src long, dst long")


def encode_names(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of names as edges of numbers, and the dictionary (name, id). Numbers follow the names' order."""
    names = both_ways(edges).select(F.col("u").alias("name")).distinct()
    ids = numbered(names, "name", into="id").select("name", "id")
    one = ids.select(F.col("name").alias("src"), F.col("id").alias("a"))
    two = ids.select(F.col("name").alias("dst"), F.col("id").alias("b"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    kept = edges.join(one, "src").join(two, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest)
    return kept, ids


def hits_into(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """For each node its number of neighbours among keep(id) and the sum of those edges' weights (1 each if none)."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), weight.alias("w"))
    both = ends.union(ends.select("v", "u", "w"))
    near = both.join(keep.select(F.col("id").alias("v")), "v", "left_semi")
    return near.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("hits"), F.sum("w").alias("weight"))


#: Parts that :func:`ortholog_pairs` makes of each key's left rows, and of all of its work.
KEY_PARTS, PAIR_PARTS = 32, 64


def ortholog_pairs(left: DataFrame, right: DataFrame, told: Callable[[Column], Column] = lambda name: name) -> DataFrame:
    """Pairs of names (name1, name2) whose last part after an underscore is the same, each name as ``told`` gives it. Keys are few and
    their pairs many: names are told before they are paired, and a key's left rows are dealt out, each part meeting all of
    its right ones. The number of tasks is given, as the rows' bytes, by which plans are adapted, say little of the pairs."""
    key = lambda c: F.element_at(F.split(c, "_"), -1).alias("__key")
    one = left.select(told(F.col("name")).alias("name1"), key(F.col("name")), F.pmod(F.xxhash64("name"), F.lit(KEY_PARTS)).cast("int").alias("__part"))
    two = right.select(told(F.col("name")).alias("name2"), key(F.col("name")), F.explode(F.sequence(F.lit(0), F.lit(KEY_PARTS - 1))).alias("__part"))
    dealt = lambda rows: rows.repartition(PAIR_PARTS, "__key", "__part")
    return dealt(one).join(dealt(two).hint("merge"), ["__key", "__part"]).select("name1", "name2")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(line, line_no): each line once, where it first stood."""
    return lines.groupBy("line").agg(F.min("line_no").alias("line_no"))


