"""Intermediate tables in the folder that the whole cluster shares.

A written table cuts lineage and survives lost executors, and is read back by column. The folder is the one in
``spark.checkpoint.dir``; only where no such setting exists and all runs on one machine, as in tests, a local folder is set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        named = tempfile.mkdtemp(prefix="motiflake-")
        context.setCheckpointDir(named)
    return named


#: A page ends with the first value that fills it. Parquet looks only every 100 rows otherwise, so that a page of wide rows has
#: most of a file, and every task that writes or reads it holds buffers of that size outside the heap.
PAGES = {"parquet.page.size.row.check.min": "1"}


@contextmanager
def batches_of(spark: SparkSession, batch: int) -> Iterator[None]:
    """Python functions get ``batch`` rows at a time at most in what runs meanwhile, as rows with whole texts or sets are wide; the
    session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(batch, int(before)) if int(before) > 0 else batch))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stash(df: DataFrame, batch: int = 1000, **options: str) -> DataFrame:
    """df, written as a table of its own with options for Parquet and read again, by ``batch`` rows as in :func:`batches_of`."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stash-{uuid.uuid4().hex}"
    with batches_of(spark, batch):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stash_by(df: DataFrame, column: str, batch: int = 1) -> DataFrame:
    """As :func:`stash`, but kept apart by the hash of a column into as many parts as shuffles have: a join on that column reads it
    where it lies, so that wide rows are not shuffled. Each task writes a file, with pages as in ``PAGES``, for each part that it has
    rows of."""
    spark = df.sparkSession
    name = f"stash_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/stash-{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with batches_of(spark, batch):
        df.write.bucketBy(parts, column).options(path=path, **PAGES).format("parquet").saveAsTable(name)
    return spark.table(name)


def drop(df: DataFrame) -> None:
    """Deletes the files of a stashed table that nothing reads any more."""
    spark = df.sparkSession
    paths = {f.rpartition("/")[0] for f in df.inputFiles()}
    for path in paths:
        if "/stash-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if "/stash-stash_" in path:
            spark.sql(f"DROP TABLE IF EXISTS {path.rpartition('/stash-')[2]}")
