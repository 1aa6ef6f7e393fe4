"""Benchmark decontamination by winnowing: every shared span of ``WINDOW`` words is found.

Texts are sequences of words. Of every ``WINDOW - GRAM + 1`` successive hashes of ``GRAM`` words the least is kept (the last of
equals), so two texts that share ``WINDOW`` words keep a common hash inside them. A bitmap of fixed size, made from the
benchmark's hashes, drops most hashes of documents at once; the rest are joined with the benchmark's. Each hash
carries the words around it, so a hit is extended to the whole shared run without going back to the texts.
Items with fewer words than a window count as one window of their own length; their hashes are of whole items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import keyed, small
from .stash import drop, stash
from .textscan import FOLD, LETTERED, U64, grams, hashes, pieces, within, words

WINDOW = 10
GRAM = 5
#: Words on each side of a kept hash that belong to a window around it.
REACH = WINDOW - GRAM
#: Bits of the bitmap, as a power of two.
BITMAP = 24
#: Rows of benchmark hashes that are broadcast at most, under 200 bytes each; beyond, the join is by shuffle.
BROADCAST_ROWS = 1 << 16

_CAND = "array<struct<hash: bigint, at: bigint, lead: int, near: array<bigint>>>"


def winnow(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (of words) whose gram is kept, in order, and the hashes there. Texts shorter than a window keep none."""
    starts, _ = within(first, WINDOW)
    if not len(starts):
        return starts, np.zeros(0, U64)
    g = grams(h, GRAM)
    best, place = g[starts + REACH], starts + REACH
    for j in range(REACH - 1, -1, -1):
        less = g[starts + j] < best
        best = np.where(less, g[starts + j], best)
        place = np.where(less, starts + j, place)
    place = np.unique(place)
    return place, g[place]


def _around(h: np.ndarray, place: np.ndarray, first: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, list]:
    """For each place the words before it that are in reach and belong to the text, and the hashes of all words
    in reach."""
    low = np.maximum(place - REACH, first[text_of])
    high = np.minimum(place + WINDOW, first[text_of + 1])
    signed = h.view(np.int64)
    return place - low, [signed[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]


def _short_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n < WINDOW words, apart from those of grams."""
    return grams(h, n) ^ U64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _item_prints(items: DataFrame, id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = words(batch.column(text), LETTERED, FOLD)
            h, first = hashes(found), found.first
            ids = batch.column(id).cast(pa.string()).to_pylist()
            place, g = winnow(h, first)
            text_of = np.searchsorted(first, place, "right") - 1
            lead, near = _around(h, place, first, text_of)
            rows = [(ids[t], int(x), int(d), w, 0) for t, x, d, w in zip(text_of, g.view(np.int64), lead, near, strict=True)]
            for t in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < WINDOW)).tolist():
                own = h[first[t] : first[t + 1]]
                rows.append((ids[t], int(_short_hash(own, len(own)).view(np.int64)[0]), 0, own.view(np.int64), len(own)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["item", "hash", "lead", "near", "short"]
            )

    return items.select(id, text).mapInArrow(run, "item string, hash long, lead int, near array<bigint>, short int")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """A bit for the high bits of every benchmark hash. Each task sends one bitmap at most, however many hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP, bool)
        for batch in batches:
            bits[(batch.column("hash").to_numpy().view(U64) >> U64(64 - BITMAP)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << BITMAP >> 3, np.uint8)
    for row in prints.select("hash").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(out).astype(bool)


def scan(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """A row per row of docs: id, n_words, spans (array<struct<start, end>>, word places that are hit, joined and in order,
    end exclusive), items (array<string>, distinct ids of items with a hit, sorted as strings).

    Words are runs of digits, letters and anything beyond ASCII, after folding A-Z. A word is hit if it lies in an
    occurrence of a window: WINDOW successive words of an item, or a whole item with fewer. Null and empty texts have no
    words and no hits; items without words or with a null id are left out. Each row is scanned by itself, so
    rows with the same id each get a row, and a null id stays. Other columns are not read.
    """
    spark = docs.sparkSession
    prints = stash(_item_prints(items.filter(F.col(item_id).isNotNull()), item_id, item_text))
    bits = spark.sparkContext.broadcast(np.packbits(_bitmap(prints)))
    shorts = sorted(r["short"] for r in prints.filter("short > 0").select("short").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.unpackbits(bits.value).astype(bool)
        for batch in pieces(batches, text):
            found = words(batch.column(text), LETTERED, FOLD)
            h, first = hashes(found), found.first
            place, g = winnow(h, first)
            hit = have[(g >> U64(64 - BITMAP)).astype(np.int64)]
            place, g = place[hit], g[hit]
            text_of = np.searchsorted(first, place, "right") - 1
            lead, near = _around(h, place, first, text_of)
            for n in shorts:
                starts, _ = within(first, n)
                x = _short_hash(h, n)[starts] if len(starts) else np.zeros(0, U64)
                ok = have[(x >> U64(64 - BITMAP)).astype(np.int64)]
                starts, x = starts[ok], x[ok]
                signed = h.view(np.int64)
                place, g = np.concatenate([place, starts]), np.concatenate([g, x])
                text_of = np.concatenate([text_of, np.searchsorted(first, starts, "right") - 1])
                lead = np.concatenate([lead, np.zeros(len(starts), lead.dtype)])
                near += [signed[a : a + n] for a in starts.tolist()]
            order = np.argsort(text_of, kind="stable")
            sizes = np.fromiter((len(near[i]) for i in order.tolist()), np.int64, len(order))
            flat = np.concatenate([*(near[i] for i in order.tolist()), np.zeros(0, np.int64)])
            cands = pa.StructArray.from_arrays(
                [
                    pa.array(g[order].view(np.int64)),
                    pa.array((place - first[text_of])[order], pa.int64()),
                    pa.array(lead[order], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)),
                ],
                ["hash", "at", "lead", "near"],
            )
            at = np.searchsorted(text_of[order], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column(id).cast(pa.int64()),
                    pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), cands),
                ],
                ["row", "id", "n_words", "cands"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), id, text)
    scanned = rows.mapInArrow(run, f"row long, id long, n_words long, cands {_CAND}")
    cands = scanned.select("row", "id", "n_words", F.explode_outer("cands").alias("c")).select(
        "row", "id", "n_words", "c.hash", "c.at", F.col("c.lead").alias("d_lead"), F.col("c.near").alias("d_near")
    )
    small = prints.count() <= BROADCAST_ROWS
    side = prints.select("item", "hash", F.col("lead").alias("i_lead"), F.col("near").alias("i_near"), "short")
    met = cands.join(F.broadcast(side) if small else side, "hash", "left")

    def same(k) -> F.Column:
        """Whether the words k places after the kept gram's start agree; k may be negative."""
        return F.coalesce(
            (k + F.col("d_lead") >= 0)
            & (k + F.col("i_lead") >= 0)
            & (F.get("d_near", k + F.col("d_lead")) == F.get("i_near", k + F.col("i_lead"))),
            F.lit(False),
        )

    back, ahead = F.lit(0), F.lit(GRAM)
    whole = F.lit(True)
    for k in range(GRAM):
        whole = whole & same(F.lit(k))
    for k in range(REACH, 0, -1):
        back = F.when(F.array_min(F.array(*(same(F.lit(-j)) for j in range(1, k + 1)))), F.greatest(back, F.lit(k))).otherwise(back)
        ahead = F.when(
            F.array_min(F.array(*(same(F.lit(GRAM + j)) for j in range(k)))), F.greatest(ahead, F.lit(GRAM + k))
        ).otherwise(ahead)
    long_hit = (F.col("short") == 0) & whole & (F.col("back") + F.col("ahead") >= WINDOW)
    short_hit = (F.col("short") > 0) & (F.col("d_near") == F.col("i_near"))
    span = F.when(
        long_hit, F.struct((F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("ahead")).alias("end"))
    ).when(short_hit, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("short")).alias("end")))
    hits = met.withColumns({"back": back, "ahead": ahead}).withColumn("span", span)
    merged = F.aggregate(
        F.sort_array("raw"),
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    # spans and items of a row are at most as many as its words; rows without a hit add nothing to either set
    found = hits.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.collect_set("span").alias("raw"),
        F.sort_array(F.collect_set(F.when(F.col("span").isNotNull(), F.col("item")))).alias("items"),
    )
    return found.select(F.col("id").alias(id), "n_words", merged.alias("spans"), "items")


def clean(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """docs without the rows that :func:`scan` finds hits in, all columns as they are.

    Each row goes by its own text: of rows with one id only those with a hit fall, and rows with a null id go by their
    text alone. Ids to drop are broadcast while they are few, else joined by shuffle.
    """
    rows, key, _ = keyed(docs, id, text)
    rows = rows.withColumn(key, F.coalesce(key, F.xxhash64(text)))
    found = scan(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), items, "key", "text", item_id, item_text)
    gone = stash(found.filter(F.size("spans") > 0).select(F.col("key").alias(key)).distinct())
    return rows.join(small(gone), key, "left_anti").select(*docs.columns)
