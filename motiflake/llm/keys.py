"""Rows told apart where ids do not do it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import unused
from .stash import drop, stash

#: Ids that are broadcast at most, 8 bytes each.
BROADCAST_IDS = 1 << 21


def small(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few; beyond, a join with them is by shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def keyed(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, str, str]:
    """docs with two columns more and their names: a key (long), and whether the row's id stands on several rows.

    The key is the id where it stands on one row, else a hash of id and text, so that different texts under one id are
    documents of their own and the same text again has the same key. A null id has a null key.
    """
    key, again = unused(docs, "__key"), unused(docs, "__again")
    own = F.col(id).cast("long")
    many = stash(docs.select(own.alias(key)).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(again)).filter(F.col(again) > 1), 10_000)
    if not many.limit(1).count():
        drop(many)
        return docs.withColumns({key: own, again: F.lit(False)}), key, again
    marked = docs.withColumn(key, own).join(small(many), key, "left").withColumn(again, F.col(again).isNotNull())
    return marked.withColumn(key, F.when(F.col(again), F.xxhash64(F.col(key), text)).otherwise(F.col(key))), key, again
