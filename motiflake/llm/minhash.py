"""Near copies by b-bit MinHash: bands find candidates, bit counts weigh them, whole shingle sets confirm them.

1. Each text becomes a set of word shingles; texts of equal sets are one class from then on, so that exact copies
   never meet in pairs.
2. ``PERMUTATIONS`` minima of a class make ``BANDS`` keys of four minima each. Of every minimum, ``BITS`` low bits are
   kept and packed, 64 bytes a class.
3. Classes with a common key are a bucket. In a bucket, classes whose estimated similarity is near the threshold hang
   together; each such cell gets a hub, the class that agrees most with the others, and gives pairs of the hub and each
   other class, as many as it has classes. Buckets over ``SPLIT`` classes are dealt out to several tasks, each with the
   bucket's smallest class as a guest; what that leaves in several components meets in step 6.
4. Pairs with a hub are confirmed on whole shingle sets, and components are found. What a class's set and its hub's
   do not share (its difference) is kept.
5. Cells that still hold several components are gone over again: each class outside a cell's largest component meets
   every class of the cell's other components. Differences from one hub give the exact size of the overlap of any two
   sets of the cell, so only true links leave the task, and only those that join components there. Cells over ``SPLIT``
   classes are worked on in blocks.
6. In buckets over ``SPLIT`` classes that still hold several components, each class outside the largest component meets
   every class of the others, in blocks. Those with an estimate near the threshold get pairs with one hub, the
   bucket's smallest class, and are gone over as in steps 4 and 5.

So a link between different texts is lost only if no band finds it (below 5e-8 at similarity 0.8, 1e-10 at 0.85) or its
estimate is five standard deviations too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import BROADCAST_IDS, keyed, small
from .rows import groups
from .stash import drop, stash
from .textscan import SPACED, U64, grams, hashes, mix, pieces, within, words

PERMUTATIONS = 128
ROWS = 4
BANDS = PERMUTATIONS // ROWS
BITS = 4
#: Classes of a bucket or cell that one task takes.
SPLIT = 4096
#: Pairs of one hub that get a copy of the hub's row to themselves.
SHARE = 1024

_SEEDS = mix(np.arange(1, PERMUTATIONS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_LOW = U64(0x1111111111111111)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one shingle, of no words none."""
    found = words(texts, SPACED)
    h, first = hashes(found), found.first
    every = grams(h, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            run = np.sort(every[a : b - size + 1])
            yield run[np.concatenate([[True], run[1:] != run[:-1]])]
        else:
            yield grams(h[a:b], b - a) if b > a else np.zeros(0, U64)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minima of non-empty sets that lie one after another in values: a row per set, a column per permutation."""
    out = np.empty((len(at), PERMUTATIONS), U64)
    for i, seed in enumerate(_SEEDS):
        out[:, i] = np.minimum.reduceat(values * seed, at)
    return out


def pack(minima: np.ndarray) -> np.ndarray:
    """The low bits of mixed minima, sixteen to a 64-bit number."""
    low = (mix(minima) & U64((1 << BITS) - 1)).reshape(len(minima), -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=U64) * U64(BITS)), axis=2)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature to many, corrected for low bits that agree by chance."""
    x = one ^ many
    x = (x | (x >> U64(1)) | (x >> U64(2)) | (x >> U64(3))) & _LOW
    same = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / PERMUTATIONS
    chance = 0.5**BITS
    return (same - chance) / (1 - chance)


def cutoff(threshold: float) -> float:
    """Estimates below this are five standard deviations or more from the threshold."""
    chance = 0.5**BITS
    p = threshold + (1 - threshold) * chance
    return threshold - 5 * (p * (1 - p) / PERMUTATIONS) ** 0.5 / (1 - chance)


def sketches(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """A row per document: its id, set size, the set's fingerprint in two numbers, packed signature and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = mix(np.arange(BANDS, dtype=U64) + U64(77))
        for batch in pieces(batches, text):
            sets = list(shingle_sets(batch.column(text), size))
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            one, two = np.zeros(len(n), U64), np.zeros(len(n), U64)
            packed: list[bytes | None] = [None] * len(n)
            keys: list[np.ndarray | None] = [None] * len(n)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                one[full] = np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), at)
                two[full] = np.add.reduceat(mix(values ^ U64(0x14057B7EF767814F)), at)
                minima = signatures(values, at)
                low = pack(minima)
                band = grams_of_bands(minima, bands)
                for j, i in enumerate(full.tolist()):
                    packed[i], keys[i] = low[j].tobytes(), band[j].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array(packed, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "n", "one", "two", "sig", "keys"],
            )

    return docs.select(id, text).mapInArrow(run, "id long, n long, one long, two long, sig binary, keys array<long>")


def grams_of_bands(minima: np.ndarray, bands: np.ndarray) -> np.ndarray:
    shaped = minima.reshape(len(minima), BANDS, ROWS)
    total = np.broadcast_to(bands, shaped.shape[:2]).copy()
    for r in range(ROWS):
        total = mix(total + shaped[:, :, r])
    return total


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    rows = np.unique(np.stack([np.concatenate([*a, none]), np.concatenate([*b, none])], 1), axis=0)
    rows = rows[rows[:, 0] != rows[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])


def _cells(least: float):
    """Step 3 over rows (key, part, rep, sig) in order: pairs of a cell's hub and another class of the cell."""

    def one(rep: np.ndarray, sig: np.ndarray, a: list, b: list) -> None:
        nibbles = (sig[:, :, None] >> (np.arange(64 // BITS, dtype=U64) * U64(BITS))) & U64((1 << BITS) - 1)
        nibbles = nibbles.reshape(len(sig), -1)
        free = np.ones(len(rep), bool)
        while free.any():
            left = nibbles[free]
            mode = np.stack([(left == U64(v)).sum(axis=0) for v in range(1 << BITS)]).argmax(axis=0)
            hub = int(np.flatnonzero(free)[(left == mode.astype(U64)).sum(axis=1).argmax()])
            cell = free & (estimate(sig[hub], sig) >= least)
            cell[hub] = True
            # members of the hub's own reach need no look around unless some class is left that they could reach
            wait = np.flatnonzero(cell).tolist()
            while wait and (free & ~cell).any():
                outside = np.flatnonzero(free & ~cell)
                if len(outside) < len(wait):
                    wait = []
                    for o in outside.tolist():
                        if (estimate(sig[o], sig[cell]) >= least).any():
                            cell[o] = True
                            wait.append(o)
                else:
                    grown = outside[estimate(sig[wait.pop()], sig[outside]) >= least]
                    cell[grown] = True
                    wait += grown.tolist()
            own = np.flatnonzero(cell)
            a.append(np.full(len(own), rep[hub]))
            b.append(rep[own])
            free &= ~cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("key", "part")):
            at, rep, sig = rows["begins"], rows["rep"], rows["sig"]
            ends = np.concatenate([at[1:], [len(rep)]])
            two = at[ends - at == 2]
            near = estimate(sig[two], sig[two + 1]) >= least
            a, b = [rep[two][near]], [rep[two + 1][near]]
            for i, j in zip(at.tolist(), ends.tolist(), strict=True):
                if j - i > 2:
                    one(rep[i:j], sig[i:j], a, b)
            yield _pairs(a, b)

    return run


def _linked(common: np.ndarray, union: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * union


def _bridges(percent: int):
    """Step 5 over rows (hub, part, block, rep, n, label, guest, delta) in order, delta being the difference from the
    hub: links between classes of different components, one of them a guest."""

    def one(rows: dict[str, np.ndarray], a: list, b: list) -> None:
        guests, seats = np.flatnonzero(rows["guest"]), np.flatnonzero(~rows["guest"])
        if not len(guests) or not len(seats):
            return
        rep, n, delta = rows["rep"], rows["n"], [np.frombuffer(d, U64) for d in rows["delta"]]
        names, label = np.unique(rows["label"], return_inverse=True)
        root = np.arange(len(names))
        size = np.array([len(d) for d in delta])
        element = np.concatenate([delta[i] for i in seats])
        owner = np.repeat(np.arange(len(seats)), size[seats])
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        for g in guests.tolist():
            low, high = np.searchsorted(element, delta[g], "left"), np.searchsorted(element, delta[g], "right")
            run = high - low
            at = np.repeat(low - np.cumsum(run) + run, run) + np.arange(run.sum())
            shared = np.bincount(owner[at], minlength=len(seats))
            apart = size[g] + size[seats] - 2 * shared
            both = n[g] + n[seats]
            common = (both - apart) // 2
            ok = np.flatnonzero(_linked(common, both - common, percent) & (root[label[seats]] != root[label[g]]))
            for k in np.unique(root[label[seats[ok]]], return_index=True)[1].tolist():
                i = int(seats[ok[k]])
                a.append(rep[[g]])
                b.append(rep[[i]])
                root[root == root[label[i]]] = root[label[g]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("hub", "part", "block")):
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            at = rows.pop("begins").tolist()
            for i, j in zip(at, [*at[1:], len(rows["rep"])], strict=True):
                one({k: v[i:j] for k, v in rows.items()}, a, b)
            yield _pairs(a, b)

    return run


def _reached(least: float):
    """Step 6 over rows (hub, part, block, rep, label, guest, sig) in order: pairs of the hub and each class that is near a
    class of another component, one of the two a guest."""

    def one(rows: dict[str, np.ndarray], a: list, b: list) -> None:
        guests, seats = np.flatnonzero(rows["guest"]), np.flatnonzero(~rows["guest"])
        sig, label = rows["sig"], rows["label"]
        hit = np.zeros(len(label), bool)
        for g in guests.tolist():
            near = seats[label[seats] != label[g]]
            near = near[estimate(sig[g], sig[near]) >= least]
            hit[near] = True
            hit[g] |= len(near) > 0
        a.append(rows["hub"][hit])
        b.append(rows["rep"][hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("hub", "part", "block")):
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            at = rows.pop("begins").tolist()
            for i, j in zip(at, [*at[1:], len(rows["rep"])], strict=True):
                one({k: v[i:j] for k, v in rows.items()}, a, b)
            yield _pairs(a, b)

    return run


def confirm(pairs: DataFrame, docs: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) on their whole sets: n_a, n_b (set sizes), linked, and delta, the elements that one set has alone."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = [s.tobytes() for s in shingle_sets(batch.column(text), size)]
            yield pa.RecordBatch.from_arrays([batch.column(id).cast(pa.int64()), pa.array(found, pa.binary())], ["rep", "set"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, linked, delta = [], [], [], []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(left.as_buffer(), U64), np.frombuffer(right.as_buffer(), U64)
                both = np.sort(np.concatenate([x, y]))
                twin = both[1:] == both[:-1]
                alone = np.ones(len(both), bool)
                alone[1:] &= ~twin
                alone[:-1] &= ~twin
                common = int(twin.sum())
                n_a.append(len(x))
                n_b.append(len(y))
                linked.append(100 * common >= percent * (len(both) - common))
                delta.append(both[alone].tobytes())
            columns = [batch.column("a"), batch.column("b"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(linked, pa.bool_()), pa.array(delta, pa.binary())],
                ["a", "b", "n_a", "n_b", "linked", "delta"],
            )

    ids = stash(pairs.select(F.col("a").alias(id)).union(pairs.select("b")).distinct(), 10_000)
    # whole texts are not shuffled while the ids are few; beyond, the join deals both out by id
    wanted = docs.select(F.col(id).cast("long").alias(id), text).join(small(ids), id, "left_semi")
    # the same text again gives the same set; other texts under one id stay, each with its own set
    of = stash(wanted.mapInArrow(sets, "rep long, set binary").dropDuplicates(["rep", "set"]))
    # a hub of many pairs has its set once for each share of them
    heavy = stash(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares")).filter("shares > 1"), 10_000)
    shared = small(heavy)
    dealt = pairs.join(shared, "a", "left").withColumn("share", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1)))).drop("shares")
    hubs = of.select(F.col("rep").alias("a"), F.col("set").alias("left")).join(shared, "a", "left")
    hubs = hubs.select("a", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    joined = dealt.join(hubs, ["a", "share"]).join(of.select(F.col("rep").alias("b"), F.col("set").alias("right")), "b")
    out = "a long, b long, n_a long, n_b long, linked boolean, delta binary"
    done = stash(joined.select("a", "b", "left", "right").mapInArrow(exact, out), 100)
    for made in (ids, of, heavy):
        drop(made)
    return done


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest id that each end of a link can reach: (rep, label). Labels spread to neighbours and then jump to
    their own label's label, so the rounds grow with the logarithm of the longest chain."""
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = stash(ends.union(ends.select("v", "u")).distinct())
    labels = stash(both.groupBy(F.col("u").alias("rep")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        spread = (
            both.join(labels, both.v == labels.rep)
            .groupBy("u")
            .agg(F.min("label").alias("near"))
            .join(labels, F.col("u") == labels.rep)
            .select("rep", F.least("near", "label").alias("label"), F.col("label").alias("old"))
        )
        jump = labels.select(F.col("rep").alias("label"), F.col("label").alias("next"))
        new = stash(
            spread.join(jump, "label", "left").select("rep", F.least("label", "next").alias("label"), "old")
        )
        changed = new.filter("label <> old").limit(1).count()
        drop(labels)
        labels = new.select("rep", "label")
        if not changed:
            drop(both)
            return labels


def _mixed(tested: DataFrame, labels: DataFrame) -> DataFrame:
    """The classes of cells that hold several components, in blocks."""
    hubs = tested.groupBy(F.col("a").alias("hub")).agg(F.min("n_a").alias("n"))
    members = tested.select(F.col("a").alias("hub"), F.col("b").alias("rep"), F.col("n_b").alias("n"), "delta").union(
        hubs.select("hub", F.col("hub").alias("rep"), "n", F.lit(b"").alias("delta"))
    )
    return _blocks(members, labels, "n", "delta")


def _blocks(members: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """Of members (hub, rep, columns), those whose hub has several components: each seat of a part with each guest of a
    block, guests being the classes outside the hub's largest component."""
    placed = members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    sizes = placed.groupBy("hub", "label").agg(F.count("*").alias("c"))
    cells = sizes.groupBy("hub").agg(
        F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("m"), F.sum("c").alias("all"), F.max("c").alias("most")
    )
    cells = cells.filter("m > 1").select(
        "hub",
        "main",
        F.ceil(F.col("all") / SPLIT).alias("parts"),
        F.ceil((F.col("all") - F.col("most")) / SPLIT).alias("blocks"),
    )
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    few = stash(cells, 10_000)
    if few.count() <= BROADCAST_IDS:
        mixed = placed.join(F.broadcast(few), "hub")
    else:  # a cell's rows are dealt out over as many tasks as it has parts
        own_part = F.pmod(F.xxhash64("rep"), F.lit(64))
        mixed = placed.withColumn("deal", own_part).join(few.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))), ["hub", "deal"])
    mixed = mixed.withColumn("guest", F.col("label") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    keep = ("rep", "label", *columns)
    seats = mixed.select("hub", own("parts").alias("part"), F.explode(upto("blocks")).alias("block"), F.lit(False).alias("guest"), *keep)
    calls = mixed.filter("guest").select(
        "hub", F.explode(upto("parts")).alias("part"), own("blocks").alias("block"), F.lit(True).alias("guest"), *keep
    )
    rows = seats.union(calls).select("hub", "part", "block", "guest", *keep)
    return rows.repartition("hub", "part", "block").sortWithinPartitions("hub", "part", "block")


def link(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """A row per document: id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``shingle`` successive words (A-Z
    folded, words split at white space). component_id is the smallest id that links reach, itself included; kept
    marks the document with that id. Fewer words than a shingle make one shingle of all; no words, a null or an
    empty text make an empty set, which links with nothing. Rows with the same id are one document for linking, and each
    gets its own row. A row with a null id is returned with a null component and kept, as nothing can name it.
    Columns other than id and text are not read.
    """
    least = cutoff(percent / 100)
    rows = stash(sketches(docs, id, text, shingle))
    named = rows.filter("n > 0 and id is not null")
    classes = stash(
        named.groupBy("one", "two").agg(
            F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
        )
    )
    keys = classes.select("rep", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low")).filter("n > 1")
    buckets = stash(
        keys.join(shared, "key")
        .withColumn("parts", F.ceil(F.col("n") / SPLIT))
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
        .select("rep", "key", "low", "parts", "part")
    )
    sigs = classes.select("rep", "sig")
    guests = buckets.filter("parts > 1 and rep = low").select(
        "rep", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    )
    first = (
        buckets.select("rep", "key", "part")
        .union(guests)
        .distinct()
        .join(sigs, "rep")
        .repartition("key", "part")
        .sortWithinPartitions("key", "part", "rep")
        .select("key", "part", "rep", "sig")
    )
    pairs = stash(first.mapInArrow(_cells(least), "a long, b long").distinct(), 10_000)
    made = [rows, classes, buckets, pairs]

    def keep(df: DataFrame) -> DataFrame:
        made.append(df)
        return df

    tested = keep(confirm(pairs, docs, id, text, shingle, percent))
    links = tested.filter("linked").select("a", "b")
    labels = keep(components(links))
    extra = keep(stash(_mixed(tested, labels).mapInArrow(_bridges(percent), "a long, b long")))
    if extra.limit(1).count():
        links = links.union(extra)
        labels = keep(components(links))
    wide = buckets.filter("parts > 1").select(F.col("low").alias("hub"), "rep").distinct().join(sigs, "rep")
    across = keep(stash(_blocks(wide, labels, "sig").mapInArrow(_reached(least), "a long, b long").distinct(), 10_000))
    if across.limit(1).count():
        tested = keep(confirm(across, docs, id, text, shingle, percent))
        links = links.union(tested.filter("linked").select("a", "b"))
        labels = keep(components(links))
        extra = _mixed(tested, labels).mapInArrow(_bridges(percent), "a long, b long")
        labels = keep(components(links.union(extra)))
    of = classes.select("one", "two", "rep").join(labels, "rep", "left")
    of = of.select("one", "two", F.coalesce("label", "rep").alias("label"))
    out = stash(
        rows.select("id", F.col("n").alias("n_shingles"), "one", "two")
        .join(of, ["one", "two"], "left")
        .select(
            F.col("id").alias(id),
            "n_shingles",
            F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("id"))).alias(
                "component_id"
            ),
        )
        .withColumn("kept", F.col("component_id").isNull() | (F.col(id) == F.col("component_id"))),
        10_000,
    )
    for df in made:
        drop(df)
    return out


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component, all columns as they are.

    The row with the smallest id stays. Rows with one id and different texts are documents of their own, each linked by its text, and
    have a hash of id and text in the id's place; of rows with the same id and text one stays. Rows with a null id
    stay. Ids to drop are broadcast while they are few, else joined by shuffle.
    """
    rows, key, again = keyed(docs, id, text)
    found = link(rows, key, text, shingle, percent)
    gone = small(found.filter("not kept").select(key).distinct())
    left = rows.join(gone, key, "left_anti")
    if not left.filter(again).limit(1).count():
        return left.select(*docs.columns)
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
    several = left.filter(again).groupBy(key).agg(one).select("row.*")
    return left.filter(~F.col(again)).select(*docs.columns).union(several)
