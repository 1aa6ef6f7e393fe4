"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, hmm, licenses, minhash, pii, piece, quality, secrets_scan, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "quality.*")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("event"), "role", "text"
    )
    # conversation -7 as a log: a user's message, edited, and an assistant's, regenerated and streamed in two parts
    said = "\\### Assistant: </turn> ok"
    told = (
        (0, 0, "message", "user", "hello"),
        (1, 0, "edit", None, said),
        (2, 1, "message", "assistant", "first try"),
        (3, 1, "regenerate", None, None),
        (4, 1, "delta", None, said[:9]),
        (5, 1, "delta", None, said[9:]),
    )
    event = lambda e: F.struct(
        *(F.lit(v).cast(kind).alias(n) for v, n, kind in zip(e, ("seq", "turn", "event", "role", "text"), ("long", "long", "string", "string", "string"), strict=True))
    )
    extra = spark.range(1).select(F.explode(F.array(*map(event, told))).alias("e"))
    extra = extra.select(F.lit(-7).cast("long").alias("conv_id"), "e.*")
    parts = chat.render(chat.fold(log.unionByName(extra)))
    told = F.transform(
        chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    read = parts.select(
        "conv_id",
        F.struct(
            "part",
            F.size(told).alias("n"),
            F.array_join(told, "").alias("turns"),
            chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"),
            F.char_length("formatted").alias("chars"),
        ).alias("p"),
    )
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    text = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x[name])
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(text("turns"), 256).alias("turns_sha256"),
        F.char_length(text("loss")).cast("long").alias("loss_chars"),
        F.sha2(text("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=85)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secrets_scan.joined(base), 256).alias("base_sha256"),
        secrets_scan.joined(F.col("secrets")).alias("spans"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("phrases", lambda p: p["start"])
    base = F.transform("phrases", lambda p: p["label"])
    # a phrase is all of its template; of a block's templates the best one counts
    shares = F.transform("blocks", lambda b: b["common"] / b["size"])
    score = F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0)))
    labels = F.concat(base, F.transform("blocks", lambda b: b["label"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("labels"),
        score.alias("score"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return decontam.scan(docs.select("doc_id", "text"), items.select("item_id", "text")).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("pseudonyms", lambda p: p["kind"] == kind)).cast("long")
    return pii.pseudonymise(docs, key="motiflake").select(
        "doc_id",
        F.size("pseudonyms").cast("long").alias("n_found"),
        *(count(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.array_join(F.transform("pseudonyms", lambda p: F.concat_ws(":", p["kind"], p["value"])), ",").alias("pseudonyms"),
        "text",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_chat_formatting,
        op3_minhash_near_dedup,
        op4_url_filters,
        op5_sentencepiece,
        op6_secret_scan,
        op7_license_scan,
        op8_benchmark_decontamination,
        op9_hmm_scores,
        op10_pii_pseudonyms,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLE

    return dict(ORACLE)
