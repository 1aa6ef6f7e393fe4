"""Graphs as DataFrames: edges(src, dst) with src < dst, each once; arcs(src, dst) with direction; edges with a weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


def arcs_between(spark: SparkSession, sf_dir: str, one: int = 1, two: int = 2) -> DataFrame:
    """From the part on one line of an order to the part on another line of it."""
    lines = _lines(spark, sf_dir)
    a = lines.filter(F.col("l_linenumber") == one).select("l_orderkey", F.col("l_partkey").alias("src"))
    b = lines.filter(F.col("l_linenumber") == two).select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").filter("src <> dst").select("src", "dst")


def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand on lines 1 and 2 of an order."""
    return clean(arcs_between(spark, sf_dir))


def g12_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As g12, with the number of such pairs of lines as weight."""
    ends = arcs_between(spark, sf_dir).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return ends.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def gadj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand on successive lines of an order."""
    lines = _lines(spark, sf_dir)
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    return clean(a.join(lines, ["l_orderkey", "l_linenumber"]).select("src", F.col("l_partkey").alias("dst")))


def two_networks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph without a twentieth of its edges, and the whole of it."""
    from ..functions.draws import draw

    whole = g12(spark, sf_dir)
    return whole.filter(draw(F.col("src"), F.col("dst"), 20) % 20 != 0), whole


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of which one's customers bought 50 of a part from the other's supplier; 25 nodes at most."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    pairs = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return clean(pairs.select("src", "dst"))
