"""Language-model scoring with a hidden Markov model, trained by Baum-Welch over the whole corpus.

1. Texts become blocks of about ``BLOCK`` bytes: word numbers local to the block, and the block's different words by
   64-bit hash. Blocks are kept apart by their number, so what is joined with them later does not move them.
2. Words are dealt out by ranges of their hash, as many as the corpus needs: a block sends each range one row with its words there,
   and gets back one with what all blocks have of them, in the same order. Nothing that grows with the vocabulary is
   broadcast or collected, and no task holds more than about ``RANGE`` words of blocks.
3. The first rounds find the states. There each word has a class: the ``OWN`` most frequent ones one each, others by their last
   three bytes, words that training texts lack one for all; the states emit classes, and parameters are
   ``CLASSES`` x states numbers. Expected counts are added up block by block with scaled forward and backward recursions,
   and summed per class.
4. The last round is over words: the expected counts of every word in every state go through step 2, so each training word has
   emissions of its own, and the model grows with the corpus.
5. The last forward pass gives the exact likelihood under that model. All texts of a block take a step together; long ones are cut
   into pieces, and each piece's transfer matrix tells the next one with which shares of the states it begins, so the result
   is that of one long recursion.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import groups
from .stash import PAGES, batches_of, drop, stash, stash_by
from .textscan import FOLD, SPACED, U64, hashes, mix, pieces, words

BLOCK = 2 << 20
#: Tokens that a recursion takes one after another; longer texts are cut, and their pieces run side by side.
PIECE = 1024
OWN = 8192
SUFFIXES = 4096
#: Words of blocks that a range of hashes has.
RANGE = 1 << 18
#: Lists of frequent words that one task merges.
MERGE = 64
#: 0 is the end, then come the words with a class of their own, the suffixes, and words that training lacks.
CLASSES = 1 + OWN + SUFFIXES + 1
UNKNOWN = CLASSES - 1
STATES = 4
ROUNDS = 4
#: How many tokens' weight the words' overall shares have in each state.
PRIOR = 100.0
#: A word's shares of the states are whole numbers of this.
WHOLE = 65535


class Model(NamedTuple):
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # CLASSES x states


def is_held_out(id: int | None) -> bool:
    return zlib.crc32(("" if id is None else str(id)).encode()) % 5 == 1


def _blocks(docs: DataFrame, id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            ids = [i for x in held for i in x[0]]
            lengths = np.concatenate([x[1] for x in held])
            h, suffix = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            out = np.array([is_held_out(i) for i in ids], bool)
            own, sample, token, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            # the commonest words get the smallest numbers, so that the upper halves are nearly all 0
            by_count = np.argsort(-n, kind="stable")
            rank = np.empty(len(own), np.uint32)
            rank[by_count] = np.arange(len(own), dtype=np.uint32)
            own, sample, token = own[by_count], sample[by_count], rank[token]
            trained = np.bincount(token[np.repeat(~out, lengths)], minlength=len(own))
            block = (TaskContext.get().partitionId() << 32) + made if TaskContext.get() else made
            made += 1
            held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([len(own)], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([out.tolist()], pa.list_(pa.bool_())),
                    pa.array([lengths.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([token.astype(np.uint16).tobytes()], pa.binary()),
                    pa.array([(token >> 16).astype(np.uint16).tobytes()], pa.binary()),
                    pa.array([own.tobytes()], pa.binary()),
                    pa.array([suffix[sample].tobytes()], pa.binary()),
                    pa.array([trained.astype(np.int32).tobytes()], pa.binary()),
                ],
                ["block", "n", "ids", "held", "lengths", "low", "high", "words", "suffixes", "trained"],
            )

        size = 0
        for batch in pieces(batches, text):
            found = words(batch.column(text), SPACED, FOLD)
            data, length = found.data, found.end - found.start
            last = np.zeros(len(length), np.uint32)
            for j in range(3):
                has = length > j
                last[has] |= data[found.end[has] - 1 - j].astype(np.uint32) << np.uint32(8 * j)
            suffix = (mix(last.astype(U64)) % U64(SUFFIXES)).astype(np.uint16)
            held.append((batch.column(id).to_pylist(), np.diff(found.first), hashes(found), suffix))
            size += len(data) + 64 * batch.num_rows
            if size >= BLOCK:
                yield flush()
                size = 0
        if held:
            yield flush()

    schema = (
        "block long, n long, ids array<bigint>, held array<boolean>, lengths binary, low binary, high binary, words binary, "
        "suffixes binary, trained binary"
    )
    return docs.select(F.col(id).cast("long").alias(id), text).mapInArrow(run, schema)


def _of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i] for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _dealt(word: np.ndarray, ranges: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of a block's words by hash, and for each range that has any of them where it begins and ends in that order."""
    order = np.argsort(word)
    of = ((word[order] >> U64(32)) * U64(ranges)) >> U64(32)
    cut = np.flatnonzero(np.diff(of, prepend=U64(ranges)))
    return order, list(zip(of[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(of)], strict=True))


def _send(block: int, word: np.ndarray, ranges: int, **given: np.ndarray) -> pa.RecordBatch:
    """A row per range: the block's words there by hash, and what is given for each."""
    order, cuts = _dealt(word, ranges)
    packed = {k: np.ascontiguousarray(v[order]) for k, v in (("words", word), *given.items())}
    columns = [pa.array([x[a:b].tobytes() for _, a, b in cuts], pa.binary()) for x in packed.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r for r, _, _ in cuts], pa.int64()), pa.array(np.full(len(cuts), block, np.int64)), *columns], ["range", "block", *packed]
    )


def _got(back: pa.Scalar, word: np.ndarray, ranges: int, kind: type, width: int = 1) -> np.ndarray:
    """What a block gets back, for each of its words."""
    out = np.zeros((len(word), width), kind)
    if back.is_valid:
        rows = sorted(zip(back.values.field("range").to_pylist(), back.values.field("told").to_pylist(), strict=True))
        out[_dealt(word, ranges)[0]] = np.frombuffer(b"".join(x for _, x in rows), kind).reshape(-1, width)
    return out


def _ranged(rows: DataFrame, ranges: int) -> DataFrame:
    return rows.repartition(ranges, "range").sortWithinPartitions("range")


def _of_range(batches: Iterator[pa.RecordBatch], **kinds: type) -> Iterator[tuple[dict, list[tuple[int, int]], np.ndarray, dict, np.ndarray]]:
    """For each range: its rows, where each one's words begin and end, the different words, what is given for each word of a
    row, and the number of the different word that it is."""
    for group in groups(batches, ("range",)):
        begins = group.pop("begins").tolist()
        for i, j in zip(begins, [*begins[1:], len(group["range"])], strict=True):
            rows = {k: v[i:j] for k, v in group.items()}
            ends = np.cumsum([0, *(len(w) // 8 for w in rows["words"])]).tolist()
            word, which = np.unique(np.frombuffer(b"".join(rows["words"]), U64), return_inverse=True)
            given = {k: np.frombuffer(b"".join(rows[k]), t) for k, t in kinds.items()}
            yield rows, list(zip(ends, ends[1:], strict=False)), word, given, which


class Layout(NamedTuple):
    """Pieces of texts, the longest first, and their tokens by step and piece."""

    widths: np.ndarray  # pieces that are longer than each step
    take: np.ndarray  # for each token by step and piece its place in the texts
    count: np.ndarray  # pieces of each text
    order: np.ndarray  # pieces by text and place, in falling length

    @property
    def begin(self) -> np.ndarray:
        """Where each text's pieces begin."""
        return np.concatenate([[0], np.cumsum(self.count)])


_TALLY = "kind int, block long, range long, told binary, word long, c long, suffix long, v long"


def _rows(kind: int, n: int, **given) -> pa.RecordBatch:
    types = {"block": pa.int64(), "range": pa.int64(), "told": pa.binary(), "word": pa.int64(), "c": pa.int64(), "suffix": pa.int64(), "v": pa.int64()}
    columns = [pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in types.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *columns], ["kind", *types])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over what blocks send by range: for each of their rows the training counts of its words in all blocks (kind 0); for each
    suffix class the sum of its words' counts and how many have one (kind 1); and the most frequent words with their suffix
    class (kind 2), ``OWN`` of a task at most."""
    sums, words_of = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    best = np.zeros((0, 3), np.int64)
    for rows, ends, word, given, which in _of_range(batches, trained=np.int32, suffixes=np.uint16):
        c = np.bincount(which, given["trained"], len(word)).astype(np.int64)
        suffix = np.zeros(len(word), np.int64)
        suffix[which] = given["suffixes"]
        sums += np.bincount(suffix, c, SUFFIXES).astype(np.int64)
        words_of += np.bincount(suffix[c > 0], minlength=SUFFIXES)
        best = np.concatenate([best, np.stack([c, word.view(np.int64), suffix], 1)[c > 0]])
        if len(best) > OWN:
            best = best[np.lexsort((best[:, 1], -best[:, 0]))[:OWN]]
        whole = c[which]
        yield _rows(0, len(ends), block=rows["block"], range=rows["range"], told=[whole[a:b].tobytes() for a, b in ends])
    have = np.flatnonzero(words_of)
    yield _rows(1, len(have), suffix=have, c=sums[have], v=words_of[have])
    yield _rows(2, len(best), word=best[:, 1], c=best[:, 0], suffix=best[:, 2])


def _shares(e: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Shares of the states but the last in expected counts e (words x states) of words that stand c times, rounded down."""
    part = e[:, :-1] / np.maximum(c, 1)[:, None]
    return np.minimum(np.floor(part * WHOLE + 1e-6), WHOLE).astype(np.uint16)


def _all_shares(told: np.ndarray) -> np.ndarray:
    """Shares of all states, the last one's being what is left."""
    part = told.astype(np.float64) / WHOLE
    return np.concatenate([part, np.maximum(1 - part.sum(axis=1, keepdims=True), 0)], 1)


def _profiles(states: int):
    """Over what blocks send by range: for each of their rows the shares of its words in all blocks (kind 0), and each state's
    sum of words' counts by those shares (kind 1; c is the state, told the sum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(states)
        for rows, ends, word, given, which in _of_range(batches, trained=np.int32, shares=np.uint16):
            n = given["trained"].astype(np.float64)
            own = _all_shares(given["shares"].reshape(len(which), states - 1)) * n[:, None]
            c = np.bincount(which, n, len(word))
            e = np.stack([np.bincount(which, own[:, j], len(word)) for j in range(states)], 1)
            told = _shares(e, c)
            total += (_all_shares(told) * c[:, None]).sum(axis=0)
            back = told[which]
            yield _rows(0, len(ends), block=rows["block"], range=rows["range"], told=[back[a:b].tobytes() for a, b in ends])
        yield _rows(1, 1, told=[total.tobytes()])

    return run


def _most_frequent(rows: DataFrame) -> list:
    """The ``OWN`` rows of the largest c, ties by word. Tasks' lists are merged ``MERGE`` at a time until that many are left, so
    that what comes to the driver is bounded however many tasks there were."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("word", "c", "suffix")], 1)])
            if len(held) > OWN:
                held = held[np.lexsort((held[:, 0], -held[:, 1]))[:OWN]]
        yield pa.RecordBatch.from_arrays([pa.array(held[:, j]) for j in range(3)], ["word", "c", "suffix"])

    n = rows.count()
    while n > max(2, MERGE) * OWN:
        rows = stash(rows.repartition(-(-n // (max(2, MERGE) * OWN)), "word").mapInArrow(best, "word long, c long, suffix long"), 10_000)
        n = rows.count()
    return rows.orderBy(F.desc("c"), "word").limit(OWN).collect()


def lay_out(lengths: np.ndarray, piece: int = PIECE) -> Layout:
    count = -(-lengths // piece)
    text = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(lengths[text] - place * piece, piece)
    order = np.argsort(-size, kind="stable")
    widths = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    at = (np.concatenate([[0], np.cumsum(lengths)])[:-1][text] + place * piece)[order]
    total = int(widths.sum())
    step = np.repeat(np.arange(len(widths)), widths)
    rank = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
    return Layout(widths, at[rank] + step, count, order)


def _transfers(model: Model, kinds: np.ndarray, lay: Layout) -> np.ndarray:
    """For each piece of texts of several, by text and place: the matrix that takes the shares of states before it to those
    after it, up to a factor."""
    s = len(model.start)
    several = np.repeat(lay.count > 1, lay.count)
    out = np.zeros((len(several), s, s))
    rank = np.flatnonzero(several[lay.order])
    if not len(rank):
        return out
    emit, back = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    # columns: each piece with each state to begin in
    now = np.tile(np.eye(s)[:, None, :], (1, len(rank), 1))
    at = 0
    for t, n in enumerate(lay.widths.tolist()):
        live = int(np.searchsorted(rank, n))
        if not live:
            break
        shown = emit.take(kinds[at + rank[:live]], axis=1)[:, :, None] * now[:, :live]
        moved = (back @ shown.reshape(s, -1)).reshape(s, live, s)
        if t % 16 == 15:
            moved /= moved.sum(axis=(0, 2))[None, :, None]
        now[:, :live] = moved
        at += n
    now /= now.sum(axis=(0, 2))[None, :, None]
    out[lay.order[rank]] = now.transpose(1, 2, 0)
    return out


def _ends(model: Model, lay: Layout, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece by text and place the shares of states before it, and how likely each state after it makes the rest
    of the text (up to a factor)."""
    s, begin = len(model.start), lay.begin[:-1]
    before = np.tile(model.start, (len(lay.order), 1))
    after = np.ones((len(lay.order), s))
    for k in range(1, int(lay.count.max(initial=0))):
        q = begin[lay.count > k] + k
        p = np.einsum("qij,qi->qj", moves[q - 1], before[q - 1])
        before[q] = p / p.sum(axis=1, keepdims=True)
    for k in range(int(lay.count.max(initial=0)) - 1, 0, -1):
        q = begin[lay.count > k] + k
        r = np.einsum("qij,qj->qi", moves[q], after[q])
        after[q - 1] = r / r.sum(axis=1, keepdims=True)
    return before, after


def forward(model: Model, kinds: np.ndarray, lay: Layout, keep: bool = False):
    """log10 likelihood of each text, kinds being laid out; with keep also the scaled forward values, the scales, and what
    follows each piece."""
    before, after = _ends(model, lay, _transfers(model, kinds, lay))
    emit, back = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    total = np.zeros(len(lay.order))
    alpha = np.empty((len(model.start), len(kinds) if keep else 0), np.float32)
    scales = np.empty(len(kinds) if keep else 0)
    now = np.ascontiguousarray(before[lay.order].T)
    at = 0
    for t, n in enumerate(lay.widths.tolist()):
        now = now[:, :n] if t == 0 else back @ now[:, :n]
        now = now * emit.take(kinds[at : at + n], axis=1)
        scale = now.sum(axis=0)
        now /= scale
        total[:n] += np.log10(scale)
        if keep:
            alpha[:, at : at + n], scales[at : at + n] = now, scale
        at += n
    by_piece = np.zeros(len(lay.order))
    by_piece[lay.order] = total
    whole = np.add.reduceat(np.concatenate([by_piece, [0.0]]), lay.begin[:-1]) if len(lay.count) else np.zeros(0)
    whole = np.where(lay.count > 0, whole, 0.0)
    return (whole, alpha, scales, after) if keep else whole


def expect(model: Model, kinds: np.ndarray, lay: Layout, by: np.ndarray | None = None, n: int = 0) -> Model:
    """Expected counts of starts, moves and emissions in texts that are laid out. Emissions are counted by class, or by the n
    numbers of by, one for each token."""
    s = len(model.start)
    _, alpha, scales, after = forward(model, kinds, lay, True)
    emit = np.ascontiguousarray(model.emit.T)
    moves = np.zeros((s, s))
    begins = np.cumsum(lay.widths) - lay.widths
    text = np.repeat(np.arange(len(lay.count)), lay.count)
    place = np.arange(len(text)) - np.repeat(lay.begin[:-1], lay.count)
    # what follows a piece: nothing after a text's last one, else the move into the next
    rest = after[lay.order].T
    follows = (place + 1 < lay.count[text])[lay.order]
    into = np.where(follows, model.move @ rest, 1.0)
    ahead = np.zeros((s, 0))
    for t in range(len(lay.widths) - 1, -1, -1):
        n, m, at = int(lay.widths[t]), ahead.shape[1], int(begins[t])
        here = alpha[:, at : at + n].astype(np.float64)
        now = np.empty((s, n))
        now[:, m:] = into[:, m:n] / (here[:, m:] * into[:, m:n]).sum(axis=0)
        if m:
            moves += here[:, :m] @ ahead.T
            now[:, :m] = model.move @ ahead
        if n > m and follows[m:n].any():
            ended = np.flatnonzero(follows[m:n]) + m
            moves += (here[:, ended] / (here[:, ended] * into[:, ended]).sum(axis=0)) @ rest[:, ended].T
        alpha[:, at : at + n] = here * now  # now the share of each state
        ahead = emit.take(kinds[at : at + n], axis=1) * now / scales[at : at + n]
    by, n = (kinds, CLASSES) if by is None else (by, n)
    emits = np.stack([np.bincount(by, alpha[j], n) for j in range(s)], 1)
    first = np.flatnonzero((place == 0)[lay.order])
    return Model(alpha[:, first].sum(axis=1, dtype=np.float64), moves * model.move, emits)


def fit(counts: Model, prior: np.ndarray, spare: np.ndarray) -> Model:
    """The model of expected counts. prior has the classes' overall shares, spare what the unigram model adds to their
    counts; each state gets its part of it, so that words that training lacks stay as likely as there."""
    start = counts.start + 1
    move = counts.move + 1
    part = (counts.emit.sum(axis=0) + 1) / (counts.emit.sum() + counts.emit.shape[1])
    emit = counts.emit + spare[:, None] * part + PRIOR * prior[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def begin_with(prior: np.ndarray, states: int) -> Model:
    """States that differ by chance, the same chance each time, and mostly stay."""
    rng = np.random.default_rng(7)
    emit = prior[:, None] * (0.2 + rng.random((len(prior), states)) ** 2)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Block(NamedTuple):
    lengths: np.ndarray  # tokens of each text, the end among them; training texts come first
    trains: int  # training texts
    cut: int  # their tokens
    token: np.ndarray  # each token's word, the end being the number of words
    word: np.ndarray
    kind: np.ndarray  # each word's class, and the end's
    count: np.ndarray  # how often training texts have each word


def _block(row: dict) -> Block:
    lengths = _array(row["lengths"], np.int32).astype(np.int64)
    trains, word = row["trains"].as_py(), _array(row["words"], U64)
    own = _array(row["low"], np.uint16).astype(np.uint32) | (_array(row["high"], np.uint16).astype(np.uint32) << np.uint32(16))
    token = np.full(len(own) + len(lengths), len(word), np.uint32)
    body = np.ones(len(token), bool)
    body[np.cumsum(lengths + 1) - 1] = False
    token[body] = own
    lengths = lengths + 1
    return Block(lengths, trains, int(lengths[:trains].sum()), token, word, _array(row["kinds"], np.uint16), _array(row["counts"], np.int64))


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """A row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words split at white space after folding A-Z, and an end. Texts whose id's crc32 (as text) is 1 modulo
    5 are held out, all others train. base_score is the unigram model's log10 probability, score the hidden Markov
    model's after ``rounds`` rounds (1 or more), the last one over words. A null or empty text is an end alone; a null id counts
    as an empty one and trains. Rows with the same id are texts of their own. With no training text, all words are unknown. Other
    columns are not read; ids that are no whole numbers raise.
    """
    spark = docs.sparkSession
    if states < 2 or rounds < 1:
        raise ValueError("two states or more, and a round")
    blocks = stash_by(_blocks(docs, id, text), "block", 2000)
    size = blocks.agg(F.sum("n").alias("n"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("texts")).first()
    ranges, texts = max(1, -(-(size["n"] or 0) // RANGE)), size["texts"] or 0

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _of_block(batches):
            yield _send(
                row["block"].as_py(), _array(row["words"], U64), ranges,
                trained=_array(row["trained"], np.int32), suffixes=_array(row["suffixes"], np.uint16),
            )

    sent_words = blocks.select("block", "words", "trained", "suffixes").mapInArrow(told, "range long, block long, words binary, trained binary, suffixes binary")
    tallied = stash(_ranged(sent_words, ranges).mapInArrow(_tally, _TALLY), 100, **PAGES)
    sums = tallied.filter("kind = 1").groupBy("suffix").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
    top = _most_frequent(tallied.filter("kind = 2").select("word", "c", "suffix"))
    n = sum(r["c"] for r in sums) + texts
    v = sum(r["v"] for r in sums) + (texts > 0)
    whole = n + 0.5 * (v + 1)
    mass = np.zeros(CLASSES)
    mass[0] = texts + 0.5 if texts else 0.0
    spare = np.zeros(CLASSES)
    spare[0] = 0.5 if texts else 0.0
    for r in sums:
        mass[1 + OWN + r["suffix"]] += r["c"] + 0.5 * r["v"]
        spare[1 + OWN + r["suffix"]] += 0.5 * r["v"]
    for i, r in enumerate(top):
        mass[1 + i], spare[1 + i] = r["c"] + 0.5, 0.5
        mass[1 + OWN + r["suffix"]] -= r["c"] + 0.5
        spare[1 + OWN + r["suffix"]] -= 0.5
    mass[UNKNOWN] = spare[UNKNOWN] = 0.5
    mass = np.maximum(mass, 0)
    prior = mass / mass.sum()
    by_hash = sorted((r["word"] & 0xFFFFFFFFFFFFFFFF, 1 + i) for i, r in enumerate(top))
    own = np.array([w for w, _ in by_hash], U64)
    own_class = np.array([c for _, c in by_hash], np.int64)
    end_kind = 0 if texts else UNKNOWN
    gathered = lambda df: df.filter("kind = 0").groupBy("block").agg(F.collect_list(F.struct("range", "told")).alias("back"))

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _of_block(batches):
            word = _array(row["words"], U64)
            c = _got(row["back"], word, ranges, np.int64)[:, 0]
            kind = 1 + OWN + _array(row["suffixes"], np.uint16).astype(np.int64)
            if len(own):
                at = np.minimum(np.searchsorted(own, word), len(own) - 1)
                kind = np.where(own[at] == word, own_class[at], kind)
            kind[c == 0] = UNKNOWN
            lengths = _array(row["lengths"], np.int32).astype(np.int64)
            token = _array(row["low"], np.uint16).astype(np.uint32) | (_array(row["high"], np.uint16).astype(np.uint32) << np.uint32(16))
            begin = np.concatenate([[0], np.cumsum(lengths)])

            def per_text(x: np.ndarray) -> np.ndarray:
                total = np.add.reduceat(np.concatenate([x[token], [0.0]]), begin[:-1])
                return np.where(lengths > 0, total, 0.0)

            base = np.log10(np.where(c == 0, 0.5, c + 0.5) / whole)
            end = np.log10((texts + 0.5) / whole)
            out = np.array(row["held"].as_py(), bool)
            order = np.argsort(out, kind="stable")  # training texts first
            length = lengths[order]
            moved = token[np.repeat(begin[order] - np.cumsum(length) + length, length) + np.arange(length.sum())]
            listed = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["block"].as_py()], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), row["ids"].values.take(pa.array(order))),
                    pa.array([int((~out).sum())], pa.int32()),
                    pa.array([length.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([moved.astype(np.uint16).tobytes()], pa.binary()),
                    pa.array([(moved >> np.uint32(16)).astype(np.uint16).tobytes()], pa.binary()),
                    pa.array([word.tobytes()], pa.binary()),
                    pa.array([np.append(kind, end_kind).astype(np.uint16).tobytes()], pa.binary()),
                    pa.array([c.tobytes()], pa.binary()),
                    listed((per_text((c > 0).astype(float)) + (texts > 0))[order].astype(np.int64), pa.int64()),
                    listed((per_text(base) + end)[order], pa.float64()),
                ],
                ["block", "ids", "trains", "lengths", "low", "high", "words", "kinds", "counts", "known", "base"],
            )

    schema = (
        "block long, ids array<bigint>, trains int, lengths binary, low binary, high binary, words binary, kinds binary, counts binary, "
        "known array<bigint>, base array<double>"
    )
    done = stash_by(blocks.join(gathered(tallied), "block", "left").mapInArrow(ready, schema), "block")
    drop(tallied)
    drop(blocks)
    wanted = ("block", "trains", "lengths", "low", "high", "words", "kinds", "counts")
    columns = [f"s{j}" for j in range(states)]

    def sums_of(df: DataFrame, n: int) -> np.ndarray:
        """Rows (place, s0, ...) added up by place."""
        out = np.zeros((n, states))
        for r in df.groupBy("place").agg(*(F.sum(c).alias(c) for c in columns)).collect():
            out[r["place"]] = r[1:]
        return out

    def placed(rows: np.ndarray) -> list[pa.Array]:
        place = np.flatnonzero(rows.any(axis=1))
        return [pa.array(place, pa.int32()), *(pa.array(rows[place, j]) for j in range(states))]

    model = begin_with(prior, states)
    for _ in range(rounds - 1):
        sent = spark.sparkContext.broadcast(tuple(model))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = None
            for row in _of_block(batches):
                block = _block(row)
                if block.cut:
                    lay = lay_out(block.lengths[: block.trains])
                    new = expect(Model(*sent.value), block.kind[block.token[: block.cut][lay.take]], lay)
                    total = new if total is None else Model(*(a + b for a, b in zip(total, new, strict=True)))
            if total is not None:
                yield pa.RecordBatch.from_arrays(placed(np.concatenate([total.start[None, :], total.move, total.emit])), ["place", *columns])

        # added up as it comes, as a table of the tasks' sums would be a file from each task in each round
        with batches_of(spark, 1):
            counted = done.select(*wanted).mapInArrow(count, "place int, " + ", ".join(f"{c} double" for c in columns))
            rows = sums_of(counted, 1 + states + CLASSES)
        model = fit(Model(rows[0], rows[1 : 1 + states], rows[1 + states :]), prior, spare)
        sent.unpersist()

    # the last round, over words
    sent = spark.sparkContext.broadcast(tuple(model))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "block", "words", "trained", "shares", "place", *columns]
        for row in _of_block(batches):
            block = _block(row)
            lay = lay_out(block.lengths[: block.trains])
            token = block.token[: block.cut][lay.take]
            size = len(block.word) + 1
            seen = expect(Model(*sent.value), block.kind[token], lay, token, size) if block.cut else Model(np.zeros(states), np.zeros((states, states)), np.zeros((size, states)))
            n = np.bincount(token, minlength=size)[:-1].astype(np.int32)
            dealt = _send(row["block"].as_py(), block.word, ranges, trained=n, shares=_shares(seen.emit[:-1], n))
            nothing = [pa.nulls(dealt.num_rows, t) for t in (pa.int32(), *[pa.float64()] * states)]
            yield pa.RecordBatch.from_arrays([*dealt.columns, *nothing], names)
            rest = placed(np.concatenate([seen.start[None, :], seen.move, seen.emit[-1:]]))
            none = [pa.nulls(len(rest[0]), t) for t in (pa.int64(), pa.int64(), *[pa.binary()] * 3)]
            yield pa.RecordBatch.from_arrays([*none, *rest], names)

    schema = "range long, block long, words binary, trained binary, shares binary, place int, " + ", ".join(f"{c} double" for c in columns)
    spread_out = stash(done.select(*wanted).mapInArrow(spread, schema), 1, **PAGES)
    sent.unpersist()
    rows = sums_of(spread_out.filter("place is not null").select("place", *columns), 2 + states)
    by_range = spread_out.filter("place is null").select("range", "block", "words", "trained", "shares")
    profiles = stash(_ranged(by_range, ranges).mapInArrow(_profiles(states), _TALLY), 100, **PAGES)
    drop(spread_out)
    emitted = rows[1 + states] + sum((np.frombuffer(r["told"]) for r in profiles.filter("kind = 1").select("told").collect()), np.zeros(states))
    start, move = rows[0] + 1, rows[1 : 1 + states] + 1
    start, move = start / start.sum(), move / move.sum(axis=1, keepdims=True)
    part = (emitted + 1) / (emitted.sum() + states)
    norm = emitted + 0.5 * (v + 1) * part + PRIOR
    at_end = (rows[1 + states] if texts else 0.0) + 0.5 * part + PRIOR * (texts + 0.5) / whole

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _of_block(batches):
            block = _block(row)
            c = block.count.astype(np.float64)[:, None]
            e = _all_shares(_got(row["back"], block.word, ranges, np.uint16, states - 1)) * c
            emit = (np.concatenate([e + 0.5 * part + PRIOR * (c + 0.5) / whole, at_end[None, :]])) / norm
            total = []
            for a, b, tokens in ((0, block.trains, block.token[: block.cut]), (block.trains, None, block.token[block.cut :])):
                lay = lay_out(block.lengths[a:b])
                total.append(forward(Model(start, move, emit), tokens[lay.take], lay))
            yield pa.RecordBatch.from_arrays(
                [
                    row["ids"].values,
                    pa.array(np.arange(len(block.lengths)) >= block.trains),
                    pa.array(block.lengths),
                    row["known"].values,
                    pa.array(np.full(len(block.lengths), n), pa.int64()),
                    row["base"].values,
                    pa.array(np.concatenate(total)),
                ],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    out = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = stash(done.join(gathered(profiles), "block", "left").mapInArrow(final, out), 1)
    drop(profiles)
    drop(done)
    return scored.withColumnRenamed("id", id)
