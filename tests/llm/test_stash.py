from pyspark.sql import functions as F

from motiflake.llm.stash import drop, stash_by


def test_a_task_writes_no_more_files_than_shuffles_have_parts(spark):
    kept = stash_by(spark.range(200).repartition(1), "id")
    assert len(kept.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert kept.agg(F.count("*"), F.sum("id")).first()[:] == (200, 199 * 100)
    drop(kept)


def test_pages_of_wide_rows_end_with_the_row_that_fills_them(spark):
    wide = spark.range(12).select(F.lit(1).alias("part"), "id", F.expr("cast(repeat(sha2(cast(id as string), 512), 20000) as binary)").alias("words"))
    kept = stash_by(wide.repartition(1), "part")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    (name,) = kept.inputFiles()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    pages = sum(reader.readOffsetIndex(b.getColumns().get(2)).getPageCount() for b in reader.getFooter().getBlocks())
    reader.close()
    assert pages >= 12
    drop(kept)
