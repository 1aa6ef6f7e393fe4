"""Readers of graph files and of what the engine's text outputs hold. All read by line in parallel; only formats whose meaning
crosses lines (GML, LEDA node lists, .xz) read whole files, one file a task."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..operators.normalize import nodes, numbered


def _pairs(lines: DataFrame, pattern: str) -> DataFrame:
    """(src, dst) from the pattern's two groups, lines without a match left out."""
    found = lines.select(F.regexp_extract("value", pattern, 1).alias("src"), F.regexp_extract("value", pattern, 2).alias("dst"))
    return found.filter("src <> ''")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files; .gz and .bz2 by Spark's codecs, .xz a file at a time."""
    if not path.endswith(".xz"):
        return spark.read.text(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                yield pd.DataFrame({"value": lzma.decompress(bytes(content)).decode().splitlines()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string")


def edge_list(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(src, dst[, weight]) as names: columns parted by spaces or tabs; empty lines and comments (#) are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    kept = _lines(spark, path).filter("trim(value) <> '' and not startswith(trim(value), '#')").select(parts.alias("p"))
    columns = [F.get("p", F.lit(0)).alias("src"), F.get("p", F.lit(1)).alias("dst")]
    if weighted:
        columns.append(F.get("p", F.lit(2)).cast("double").alias("weight"))
    return kept.select(*columns)


def csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    return spark.read.schema("src string, dst string").csv(path, sep=sep)


def lgf(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``src dst label weight``; every row counts."""
    found = _lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter("size(p) >= 4")
    return found.filter("p[2] rlike '^-?[0-9]+$' and p[3] rlike '^-?[0-9]+$'").select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))


def graphml(spark: SparkSession, path: str) -> DataFrame:
    lines = _lines(spark, path)
    one = F.regexp_extract("value", r"""source\s*=\s*["']([^"']*)["']""", 1)
    two = F.regexp_extract("value", r"""target\s*=\s*["']([^"']*)["']""", 1)
    return lines.select(one.alias("src"), two.alias("dst")).filter("src <> '' and dst <> ''")


def gml(spark: SparkSession, path: str) -> DataFrame:
    """Edges of ``edge [ source a target b ]`` blocks, whatever the line ends."""
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"edge\s*\[([^\]]*)\]"), F.lit(1))).alias("value"))
    name = lambda key: F.regexp_extract("value", rf"""{key}\s+"?([^\s"\]]+)""", 1)
    return blocks.select(name("source").alias("src"), name("target").alias("dst"))


def leda(spark: SparkSession, path: str) -> DataFrame:
    """Edges ``a b x |{...}|`` by the names of the nodes listed before, or by number where nodes have no names."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("no", "value"))
    names = lines.filter(r"value rlike '^\\|\\{.*\\}\\|$'").select("no", F.regexp_extract("value", r"^\|\{(.*)\}\|$", 1).alias("name"))
    first = names.agg(F.min("no").alias("first"))
    known = names.join(F.broadcast(first)).select((F.col("no") - F.col("first") + 1).cast("string").alias("k"), "name")
    edges = _pairs(lines, r"^(\d+)\s+(\d+)\s+\S+\s+\|\{.*\}\|\s*$")
    one = known.select(F.col("k").alias("src"), F.col("name").alias("a"))
    two = known.select(F.col("k").alias("dst"), F.col("name").alias("b"))
    told = edges.join(one, "src", "left").join(two, "dst", "left")
    named = told.withColumns({"a": F.coalesce("a", F.lit("")), "b": F.coalesce("b", F.lit(""))})
    return named.select(F.when(F.col("a") != "", F.col("a")).otherwise(F.col("src")).alias("src"), F.when(F.col("b") != "", F.col("b")).otherwise(F.col("dst")).alias("dst"))


READERS = {".el": edge_list, ".txt": edge_list, ".csv": csv, ".lgf": lgf, ".graphml": graphml, ".xml": graphml, ".gml": gml, ".gw": leda, ".leda": leda}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A graph file by its ending, compression aside."""
    plain = path
    for packed in (".gz", ".bz2", ".xz"):
        plain = plain.removesuffix(packed)
    for ending, reader in READERS.items():
        if plain.endswith(ending):
            return reader(spark, path)
    raise ValueError(f"{path}: none of {', '.join(READERS)}")


def checked(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a file whose first line has the numbers of nodes and edges and each other line an edge of nodes numbered from
    0. Numbers out of range, loops, edges that come twice in either direction, and a wrong count are errors."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("no"), F.split(F.trim("value"), r"\s+").alias("p")).filter("p[0] <> ''")
    head = lines.orderBy("no").first()
    if head is None or len(head["p"]) != 2:
        raise ValueError(f"{path}: the first line is not the numbers of nodes and edges")
    n, m = map(int, head["p"])
    edges = lines.filter(F.col("no") > head["no"]).select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"))
    told = edges.agg(
        F.count("*").alias("m"),
        F.count_if((F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= n)).alias("out"),
        F.count_if(F.col("src") == F.col("dst")).alias("loops"),
    ).first()
    if told["out"]:
        raise ValueError(f"{path}: {told['out']} edges have a node that is not from 0 to {n - 1}")
    if told["loops"]:
        raise ValueError(f"{path}: {told['loops']} edges begin and end at one node")
    if told["m"] != m:
        raise ValueError(f"{path}: {told['m']} edges, not {m}")
    twice = edges.groupBy(F.least("src", "dst"), F.greatest("src", "dst")).count().filter("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"{path}: an edge comes twice")
    return edges


def interest(spark: SparkSession, path: str, edges: DataFrame) -> DataFrame:
    """(id) of nodes of interest, a name a line. Names that come twice or that no edge has are an error."""
    listed = spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")
    if listed.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError(f"{path}: a node comes twice")
    unknown = listed.join(nodes(edges), "id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"{path}: {unknown[0]['id']} is no node of the graph")
    return listed


def importance(spark: SparkSession, path: str) -> DataFrame:
    """(id, weight)."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter("size(p) >= 2")
    return parts.select(F.col("p")[0].alias("id"), F.col("p")[1].cast("double").alias("weight"))


def orbit_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(node, vector): a name and counts a line. A line that holds only a number is the size, a name alone has an empty vector."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    kept = parts.filter("p[0] <> '' and not (size(p) = 1 and p[0] rlike '^[0-9]+$')")
    return kept.select(F.col("p")[0].alias("node"), F.slice("p", F.lit(2), F.size("p")).cast("array<bigint>").alias("vector"))


def orbit_value(vectors: DataFrame, known: DataFrame, orbit: int) -> DataFrame:
    """(id, heur): one orbit's count for each of known(id), 0 where there is none."""
    own = vectors.select(F.col("node").alias("id"), F.get("vector", F.lit(orbit)).cast("double").alias("heur"))
    return known.select("id").join(own, "id", "left").withColumn("heur", F.coalesce("heur", F.lit(0.0)))


def index_lines(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(line_no, key, nodes) of an index file, in the file's order."""
    marked = spark.read.text(path).select(F.monotonically_increasing_id().alias("raw"), F.split(F.trim("value"), r"\s+").alias("p"))
    kept = marked.filter(F.size("p") == k + 1).select("raw", F.col("p")[0].alias("key"), F.slice("p", 2, k).alias("nodes"))
    return numbered(kept, "raw", into="line_no").select("line_no", "key", "nodes")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(key, nodes1, nodes2): three columns, the nodes parted by commas."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter("size(p) = 3")
    return parts.select(F.col("p")[0].alias("key"), F.split(F.col("p")[1], ",").alias("nodes1"), F.split(F.col("p")[2], ",").alias("nodes2"))


def ranked_seeds(spark: SparkSession, path: str, seed: int = 1) -> DataFrame:
    """(place, line_no, key, nodes1, nodes2, similarity): seeds of four columns, the last a similarity, by falling similarity; those
    that are alike follow one another by chance. A line's seed is the row with its line_no."""
    marked = spark.read.text(path).select(F.monotonically_increasing_id().alias("raw"), F.split(F.trim("value"), r"\s+").alias("p")).filter("size(p) = 4")
    rows = numbered(marked, "raw", into="line_no").select(
        "line_no", F.col("p")[0].alias("key"), F.split(F.col("p")[1], ",").alias("nodes1"), F.split(F.col("p")[2], ",").alias("nodes2"), F.col("p")[3].cast("double").alias("similarity")
    )
    mixed = rows.withColumns({"neg": -F.col("similarity"), "by": draw(seed, F.col("line_no"), "tie")})
    return numbered(mixed, "neg", "by", "line_no", into="place").drop("neg", "by")


def orthologs(spark: SparkSession, path: str, one: str, two: str) -> DataFrame:
    """(n1, n2) of two species' columns of a table; 0 is missing."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col(one).alias("n1"), F.col(two).alias("n2")).filter("n1 <> '0' and n2 <> '0'")


def similarities(spark: SparkSession, path: str) -> DataFrame:
    """(n1, n2, similarity): three columns; kept as rows, never as a matrix."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter("size(p) = 3")
    return parts.select(F.col("p")[0].alias("n1"), F.col("p")[1].alias("n2"), F.col("p")[2].cast("double").alias("similarity"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, n, m, density, nodes) of lines as :func:`..operators.local.cluster_lines` writes them."""
    marked = spark.read.text(path).select(F.monotonically_increasing_id().alias("raw"), F.regexp_extract_all("value", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)).alias("p"))
    rows = numbered(marked.filter("size(p) > 4"), "raw", into="cluster")
    return rows.select(
        "cluster", F.col("p")[0].cast("long").alias("n"), F.col("p")[1].cast("long").alias("m"), F.col("p")[3].cast("double").alias("density"),
        F.slice("p", F.lit(5), F.size("p")).cast("array<bigint>").alias("nodes"),
    )


def partition(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(node, community): a community a line, its nodes parted by spaces; nodes of known(id) that none has make one more."""
    marked = spark.read.text(path).select(F.monotonically_increasing_id().alias("raw"), F.split(F.trim("value"), r"\s+").alias("p"))
    listed = numbered(marked.filter("p[0] <> ''"), "raw", into="community").select(F.explode("p").alias("node"), "community")
    rest = known.select(F.col("id").alias("node")).join(listed, "node", "left_anti").withColumn("community", F.lit(-1).cast("long"))
    return listed.union(rest)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(score, u, v)."""
    return spark.read.schema("score double, u string, v string").csv(path, sep="\t")
