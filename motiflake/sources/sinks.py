"""Results as text files, a line a row, written in parallel, and graphs as edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_list(edges: DataFrame, path: str) -> None:
    columns = [c for c in ("src", "dst", "weight") if c in edges.columns]
    edges.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value")).write.text(path)


def frequency(found: DataFrame, path: str) -> None:
    """``count ordinal``."""
    found.select(F.concat_ws(" ", F.col("count").cast("string"), F.col("ordinal").cast("string")).alias("value")).write.text(path)


def index(rows: DataFrame, path: str) -> None:
    """``key node ... node`` of (id or key, nodes)."""
    key = "key" if "key" in rows.columns else "id"
    rows.select(F.concat_ws(" ", F.col(key), F.array_join(F.col("nodes").cast("array<string>"), " ")).alias("value")).write.text(path)


def vectors(rows: DataFrame, path: str) -> None:
    """``node count ... count`` of a node's row of counts."""
    rest = [F.col(c).cast("string") for c in rows.columns if c != "node"]
    rows.select(F.concat_ws(" ", F.col("node").cast("string"), *rest).alias("value")).write.text(path)


def communities(rows: DataFrame, path: str) -> None:
    """``node id count<TAB>neighbours`` of (node, id, count, neighbours)."""
    left = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("node", "id", "count")))
    rows.select(F.concat_ws("\t", left, F.array_join(F.col("neighbours").cast("array<string>"), " ")).alias("value")).write.text(path)


def predictions(rows: DataFrame, path: str) -> None:
    """``score<TAB>u<TAB>v``."""
    rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("score", "u", "v"))).alias("value")).write.text(path)


def lines(rows: DataFrame, path: str, column: str = "line") -> None:
    rows.select(F.col(column).alias("value")).write.text(path)


def catalog(table: DataFrame, path: str) -> None:
    """A catalog as Parquet, one folder per k if it has that column."""
    writer = table.write
    (writer.partitionBy("k") if "k" in table.columns else writer).parquet(path)
