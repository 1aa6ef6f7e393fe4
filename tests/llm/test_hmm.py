import math
import zlib
from collections import Counter

import numpy as np
import pytest

from motiflake.llm import hmm

from .helpers import TEXTS, documents, spaced


def simple(m, x):
    """One long forward and backward recursion."""
    a = m.start * m.emit[x[0]]
    al, sc = [a / a.sum()], [a.sum()]
    for w in x[1:]:
        a = (al[-1] @ m.move) * m.emit[w]
        al.append(a / a.sum())
        sc.append(a.sum())
    be, mv = [np.ones(len(m.start))], np.zeros(m.move.shape)
    for t in range(len(x) - 1, 0, -1):
        ahead = m.emit[x[t]] * be[0] / sc[t]
        mv += np.outer(al[t - 1], ahead) * m.move
        be.insert(0, m.move @ ahead)
    g, em = np.array(al) * np.array(be), np.zeros(m.emit.shape)
    for w, r in zip(x, g):
        em[w] += r
    return np.log10(sc).sum(), g[0], mv, em


@pytest.mark.parametrize("piece", [1000, 8, 5, 1])
def test_recursions_by_pieces(monkeypatch, piece):
    monkeypatch.setattr(hmm, "CLASSES", 7)
    rng = np.random.default_rng(0)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3).T)
    lengths = np.array([1, 5, 17, 40, 3, 0, 64, 23, 16, 8])
    kinds = rng.integers(0, 7, lengths.sum()).astype(np.uint16)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    lay = hmm.lay_out(lengths, piece)
    got, counts = hmm.forward(m, kinds[lay.take], lay), hmm.expect(m, kinds[lay.take], lay)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    for i, n in enumerate(lengths):
        if not n:
            assert got[i] == 0
            continue
        total, g, mv, em = simple(m, kinds[begin[i] : begin[i + 1]])
        assert got[i] == pytest.approx(total, abs=1e-9)
        start, move, emit = start + g, move + mv, emit + em
    for a, b in ((start, counts.start), (move, counts.move), (emit, counts.emit)):
        assert np.abs(a - b).max() < 1e-5


def corpus():
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)]
    rng = np.random.default_rng(3)
    for i in range(300):
        side = "ab"[i % 2]
        rows.append((100 + i, " ".join(f"{side}{int(w)}" for w in rng.zipf(1.5, rng.integers(5, 60)) % 50), "en"))
    return [*rows, (None, "no id at all", "en"), (100, "twice the id", "en")]


def base(rows):
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _, _ in rows]
    c = Counter(w for (_, t, _), o in zip(rows, out) if not o for w in [*spaced(t), "\n"])
    n, v = sum(c.values()), len(c)
    for (i, t, _), o in zip(rows, out):
        x = [*spaced(t), "\n"]
        yield str(i), o, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 4096)  # several blocks, so that words are counted across them
    rows = corpus()
    got = hmm.score(documents(spark, rows).repartition(3)).collect()
    told = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    want = sorted(base(rows))
    assert [t[:5] for t in told] == [w[:5] for w in want]
    assert all(a[5] == pytest.approx(b[5], abs=1e-4) for a, b in zip(told, want))


def test_states_help_on_held_out_texts(spark):
    got = [r for r in hmm.score(documents(spark, corpus()[len(TEXTS) : -2])).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def plain_scores(rows, states, rounds):
    """The whole training by plain recursions, text by text; every word is frequent enough for a class of its own."""
    import pyarrow as pa

    from motiflake.llm.textscan import hashes, words

    texts = [[*spaced(t), "\n"] for _, t, _ in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _, _ in rows]
    c = Counter(w for x, own in zip(texts, train) if own for w in x)
    ends = c.pop("\n")
    hashed = lambda w: int(hashes(words(pa.array([w])))[0].view(np.int64))
    listed = sorted(c, key=lambda w: (-c[w], hashed(w)))
    number = {"\n": 0, **{w: 1 + i for i, w in enumerate(listed)}}
    kinds = [[number.get(w, hmm.UNKNOWN) for w in x] for x in texts]
    count = np.zeros(hmm.CLASSES)
    count[0] = ends
    for w in listed:
        count[number[w]] = c[w]
    spare = np.where(count > 0, 0.5, 0.0)
    spare[hmm.UNKNOWN] = 0.5
    prior = (count + spare) / (count + spare).sum()
    model = hmm.begin_with(prior, states)
    for r in range(rounds):
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape)
        for x, own in zip(kinds, train):
            if own:
                _, g, mv, em = simple(model, x)
                start, move, emit = start + g, move + mv, emit + em
        if r < rounds - 1:
            model = hmm.fit(hmm.Model(start, move, emit), prior, spare)
    part = (emit.sum(axis=0) + 1) / (emit.sum() + states)
    last = emit + spare[:, None] * part + hmm.PRIOR * prior[:, None]
    model = hmm.Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), last / last.sum(axis=0))
    assert model.emit.sum(axis=0) == pytest.approx(np.ones(states))
    return [simple(model, x)[0] for x in kinds]


@pytest.mark.parametrize("states,rounds", [(4, 3), (2, 1)])
def test_scores_are_those_of_plain_training(spark, monkeypatch, states, rounds):
    monkeypatch.setattr(hmm, "BLOCK", 2048)
    monkeypatch.setattr(hmm, "RANGE", 50)  # several ranges of words
    monkeypatch.setattr(hmm, "PIECE", 16)
    rows = [(1000 + i, t, "en") for i, (_, t, _) in enumerate(corpus()) if t is None or len(t) < 400][:150]
    want = plain_scores(rows, states, rounds)
    got = {r["doc_id"]: r["score"] for r in hmm.score(documents(spark, rows).repartition(3), states=states, rounds=rounds).collect()}
    for (i, _, _), x in zip(rows, want):
        assert got[i] == pytest.approx(x, rel=2e-3), i


def test_empty_and_untrained(spark):
    assert hmm.score(documents(spark, [])).count() == 0
    held = next(i for i in range(100) if hmm.is_held_out(i))
    got = hmm.score(documents(spark, [(held, "all is new", "en")])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(4, 0, 0)]
    assert got[0]["base_score"] == pytest.approx(0) and math.isfinite(got[0]["score"])


def test_emissions_sum_to_one():
    prior = np.full(hmm.CLASSES, 1 / hmm.CLASSES)
    m = hmm.begin_with(prior, 4)
    assert m.emit.sum(axis=0) == pytest.approx(np.ones(4)) and m.move.sum(axis=1) == pytest.approx(np.ones(4))
    f = hmm.fit(hmm.Model(np.ones(4), np.ones((4, 4)), m.emit * 50), prior, prior)
    assert f.emit.sum(axis=0) == pytest.approx(np.ones(4)) and f.move.sum(axis=1) == pytest.approx(np.ones(4))


def test_most_frequent_words_by_merging(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(hmm, "MERGE", 1)
    rows = spark.range(3 * hmm.OWN).select(F.col("id").alias("word"), (F.col("id") * 7919 % 1000).alias("c"), F.lit(0).cast("long").alias("suffix"))
    got = [(r["word"], r["c"]) for r in hmm._most_frequent(rows.repartition(5))]
    want = sorted(((i, i * 7919 % 1000) for i in range(3 * hmm.OWN)), key=lambda x: (-x[1], x[0]))[: hmm.OWN]
    assert got == want


def test_rounds_write_no_tables(spark, monkeypatch):
    made = []
    monkeypatch.setattr(hmm, "stash", lambda *a, real=hmm.stash, **k: made.append(1) or real(*a, **k))
    tables = []
    for rounds in (1, 3):
        made.clear()
        hmm.score(documents(spark, corpus()[-20:]), rounds=rounds)
        tables.append(len(made))
    assert tables[0] == tables[1]
