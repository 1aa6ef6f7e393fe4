import random
from collections import defaultdict

import numpy as np
import pytest

from motiflake.llm import minhash
from motiflake.llm.textscan import U64

from .helpers import TEXTS, documents, spaced


def brute(rows, size, percent):
    sets = {}
    for i, t, _ in rows:
        w = spaced(t)
        grams = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(frozenset(grams))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = [(i, s) for i, ss in sets.items() for s in ss if s]
    for a, (i, x) in enumerate(listed):
        for j, y in listed[a + 1 :]:
            if i != j and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in sets}, sets


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_components(spark, size, percent):
    rng = random.Random(size)
    texts = list(TEXTS)
    for edits in (1, 2, 4, 8, 12):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(150)]
        texts += copies(rng, base, 25, edits)
    # a chain: each text is near the next one only
    base = [f"c{i}" for i in range(400)]
    texts += [" ".join(base[10 * i : 10 * i + 200]) for i in range(12)]
    texts += [texts[20]] * 40 + ["one", "ONE", "one two"]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t, "en") for i, t in enumerate(texts)]
    want, sets = brute(rows, size, percent)
    got = minhash.link(documents(spark, rows), shingle=size, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]]
        assert r["n_shingles"] == len(sets[r["doc_id"]][0])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_blocks_of_large_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SPLIT", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, t, "en") for i, t in enumerate(copies(rng, base, 120, 14))]
    want, _ = brute(rows, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(documents(spark, rows), shingle=3, percent=85).collect()}
    assert got == want


def test_star_over_parts_of_a_bucket(spark, monkeypatch):
    """Copies that are near their source only; the source is not the smallest id."""
    monkeypatch.setattr(minhash, "SPLIT", 16)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = [(500, " ".join(base), "en")]
    for i in range(120):
        words = base[:]
        for at in rng.sample(range(4, 196, 4), 5):
            words[at] = f"e{i}-{at}"
        rows.append((i + 1, " ".join(words), "en"))
    want, sets = brute(rows, 3, 85)
    copies_only, _ = brute(rows[1:], 3, 85)
    assert set(want.values()) == {1} and len(set(copies_only.values())) > 60
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(documents(spark, rows), shingle=3, percent=85).collect()}
    assert got == want


def test_repeated_ids_nulls_and_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "en"), (5, long, "en"), (2, long + " more", "en"), (9, "other text that stands alone here", "en"), (None, long, "en"), (7, None, "en"), (8, "", "en")]
    df = documents(spark, rows)
    got = minhash.link(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert by[5] == {2} and by[2] == {2} and by[9] == {9} and by[None] == {None} and by[7] == {7}
    left = minhash.keep_one(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in left.collect() if r["doc_id"] is not None) == [(False, i) for i in (2, 7, 8, 9)]
    twice = documents(spark, [(1, long, "en"), (1, long, "en")])
    assert minhash.keep_one(twice).count() == 1
    assert minhash.link(documents(spark, [])).count() == 0


def test_one_id_on_several_texts(spark, monkeypatch):
    """Texts of one id are documents of their own: only near copies go, whichever id they have."""
    from motiflake.llm import keys

    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a"), "en"), (1, text("b"), "en"), (1, text("b") + " x", "en"), (1, text("c"), "en"), (1, text("c"), "en"), (2, text("a"), "en"), (3, text("d"), "en"), (1, None, "en")]
    for most in (keys.BROADCAST_IDS, 0):
        monkeypatch.setattr(keys, "BROADCAST_IDS", most)
        left = minhash.keep_one(documents(spark, rows))
        assert left.columns == documents(spark, rows).columns
        kinds = sorted("" if r["text"] is None else r["text"][0] for r in left.collect())
        assert kinds == ["", "a", "b", "c", "d"]


def test_pairs_of_a_hub_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHARE", 4)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    rng = random.Random(9)
    rows = [(i, t, "en") for i, t in enumerate(copies(rng, [f"w{i}" for i in range(120)], 80, 12))]
    want, _ = brute(rows, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in minhash.link(documents(spark, rows), shingle=3, percent=85).collect()} == want


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 3000).astype(U64)
    for shared in (0, 500, 900):
        a, b = values[:1000], np.concatenate([values[:shared], values[2000 : 3000 - shared]])
        sig = minhash.pack(minhash.signatures(np.concatenate([a, b]), np.array([0, 1000])))
        j = shared / (2000 - shared)
        assert abs(minhash.estimate(sig[0], sig[1:])[0] - j) < 0.2
    assert minhash.cutoff(0.85) < 0.75
