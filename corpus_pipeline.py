"""From raw documents to token ids: quality rules, near copies, benchmark leaks, secrets, tokens.

Each stage takes all rows that the one before kept. ``run`` writes what a stage returns as Parquet into the folder that the
cluster shares and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiflake.llm import decontam, minhash, piece, quality, secrets_scan
from motiflake.llm.columns import unused
from motiflake.llm.stash import drop, stash

#: What takes a secret's place in a text.
MASK = "[SECRET]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each judged by itself: a null, empty or short text goes, texts of any length are
    read whole, and rows that come twice are judged twice. An empty table stays one."""
    told = unused(docs, "__quality")
    return quality.judge(docs, into=told).filter(F.col(told)["kept"]).drop(told)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest id of a group stays; texts without words are in no group, so they and rows with a null id stay. Rows with one
    id and different texts are documents of their own, and of rows with the same id and text one stays."""
    return minhash.keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. A null or empty text has none; each row goes by its own text, whatever
    other rows have its id. Without benchmark items all stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text. Null and empty texts, and those without a secret, stay as
    they are; rows are masked one by one, so repeats don't matter."""
    told = unused(docs, "__secrets")
    masked = secrets_scan.scan(docs, into=told, mask=MASK)
    hit = F.size(told) > 0
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.drop(told)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with an end id, their number, and a digest of what they decode to. A null or empty text is
    the end id alone; each row gets its own, whatever id it has."""
    return piece.encode(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", mask_secrets),
    ("sentencepiece", tokens),
]

#: Neither the signatures' components nor the merges of the tokenizer are SQL; tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = stash(stage(spark, docs, sf_dir))
        if k:
            drop(docs)
        docs = done
    return docs
