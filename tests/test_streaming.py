import time

from pyspark.sql import functions as F

from motiflake.functions import graphlets
from motiflake.streaming import online


def run(query):
    query.processAllAvailable()
    query.stop()


def test_running_degrees(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    run(online.degree_counts(stream).writeStream.outputMode("complete").format("memory").queryName("deg").start())
    assert {r["id"]: r["deg"] for r in spark.table("deg").collect()} == {1: 1, 2: 3, 3: 1, 4: 1}


def test_orbits_duplicates_and_windows(spark, tmp_path):
    tri, path = graphlets.encode([(0, 1), (1, 2), (0, 2)], 3), graphlets.encode([(0, 1), (1, 2)], 3)
    rows = [("2024-01-01 00:00:00", [1, 2, 3], tri), ("2024-01-01 00:00:01", [3, 2, 1], tri), ("2024-01-01 00:00:02", [4, 5, 6], path)]
    df = spark.createDataFrame(rows, "ts string, nodes array<bigint>, gint long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(online.recent_once(read(), "1 hour").writeStream.outputMode("append").format("memory").queryName("once").start())
    assert spark.table("once").count() == 2
    run(online.orbit_counts(read(), 3).writeStream.outputMode("complete").format("memory").queryName("orb").start())
    got = {(r["node"], r["orbit"]): r["count"] for r in spark.table("orb").collect()}
    assert got[(1, 5)] == 2 and got[(5, 4)] == 1 and got[(4, 3)] == 1
    kept = []
    run(online.count_batches(read().select("nodes", "gint"), 3, lambda c, b: kept.append(c.collect())).start())
    assert {r["ordinal"]: r["count"] for r in kept[0]} == {3: 2, 2: 1}


def test_walk_state(spark, tmp_path):
    steps = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 2, 3), (1, 2, 3, 4), (2, 0, 7, 8)], "chain long, step long, u long, v long")
    steps.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in"))
    run(online.walk_windows(stream, 2).writeStream.outputMode("append").format("memory").queryName("walk").start())
    time.sleep(0.1)
    assert sorted((r["chain"], r["step"], r["nodes"]) for r in spark.table("walk").collect()) == [(1, 1, [1, 2, 3]), (1, 2, [2, 3, 4])]
