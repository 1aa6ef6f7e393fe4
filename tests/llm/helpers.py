"""Plain Python versions of the contracts, and texts that try them."""

from __future__ import annotations

import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

TEXTS = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "one",
    "One TWO",
    "   é́ ñ 中文 \U0001f600 ß",
    "a b c d e f g h a b c d e f g h",
    "same same same same same same same same same same same same",
    "line\nline\n\nline \nother\r\nother\r\n",
    "# * $ % & | < >",
    "tab\tsep\x1fkept\x00zero",
    "the of and to " * 300,
    "x" * 30000,
    "a-b_c.d " * 2000,
]


def spaced(text: str | None, fold: bool = True) -> list[str]:
    text = text or ""
    return SPACED.findall(text.translate(FOLD) if fold else text)


def lettered(text: str | None) -> list[str]:
    return LETTERED.findall((text or "").translate(FOLD))


def documents(spark, rows, extra: bool = True):
    """A documents table of (doc_id, text, lang), with a column whose names clash with what operators make inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if extra:
        for name in ("id", "row", "key", "rep", "words", "n_words", "kept", "spans", "quality", "block", "ids", "__key", "__again", "__quality", "__secrets", "__pii_done"):
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df
