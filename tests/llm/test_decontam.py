import random

from motiflake.llm import decontam

from .helpers import TEXTS, documents, lettered


def brute(text, items):
    words, hit, found = lettered(text), set(), set()
    for item, t in items:
        own = lettered(t)
        if item is None or not own:
            continue
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for p in range(len(words) - n + 1):
            if tuple(words[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(str(item))
    return len(words), hit, sorted(found)


def cases():
    rng = random.Random(2)
    w = lambda n: [f"w{rng.randint(0, 60)}" for _ in range(n)]
    items = [(i, " ".join(w(rng.randint(10, 40)))) for i in range(20)]
    items += [(100, "Short ITEM, of six words here"), (101, "w1"), (102, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (103, None), (104, "..."), (None, "w1 w2"), (105, "x " * 30), (2, items[3][1])]
    texts = list(TEXTS) + ["x " * 200, "short item of six words here", "w9 w1 w2 w3 w4 w5 w6 w7 w8 w9 w1"]
    for _ in range(80):
        body = w(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            own = lettered(rng.choice(items[:20])[1])
            a = rng.randint(0, len(own) - 1)
            body[len(body) // 2 : len(body) // 2] = own[a : a + rng.randint(5, 30)]
        texts.append(", ".join(body))
    return texts, items


def check(spark, texts, items):
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    given = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(documents(spark, rows), given).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = brute(texts[r["doc_id"]], items)
        places = [p for s in r["spans"] for p in range(s["start"], s["end"])]
        assert r["n_words"] == n
        assert sorted(places) == sorted(hit), (r["doc_id"], r["spans"])
        assert r["items"] == found


def test_against_brute_force(spark):
    check(spark, *cases())


def test_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    check(spark, *cases())


def test_small_bitmap(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BITMAP", 6)  # nearly full: the join has to do the work
    check(spark, *cases())


def test_clean(spark):
    passage = " ".join(f"b{i}" for i in range(15))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, "so " + passage, "en"), (2, "clean", "en"), (2, "clean", "en"), (None, passage, "en"), (None, "fine", "en"), (3, None, "en")]
    df = documents(spark, rows)
    left = decontam.clean(df, items)
    assert left.columns == df.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in left.collect()) == sorted(str(x) for x in [(2, "clean"), (2, "clean"), (None, "fine"), (3, None)])
    several = documents(spark, [(1, passage, "en"), (1, "fine", "en"), (1, "fine too", "en"), (2, "fine", "en")])
    assert sorted(r["text"] for r in decontam.clean(several, items).collect()) == ["fine", "fine", "fine too"]
    none = items.limit(0)
    assert decontam.clean(df, none).count() == len(rows)
    assert decontam.scan(documents(spark, []), items).count() == 0
