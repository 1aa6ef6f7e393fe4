"""Intermediate tables of loops, written into the folder that the whole cluster shares and read again.

That cuts lineage and survives lost executors. The folder is the one in ``spark.checkpoint.dir``; only where no such
setting exists and all runs on one machine, as in tests, a local folder is set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="motiflake-")
        context.setCheckpointDir(folder)
    return folder


def stash(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/loop-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
