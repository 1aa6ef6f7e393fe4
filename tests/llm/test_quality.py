import re
from collections import Counter

import pytest

from motiflake.llm import quality

from .helpers import SPACED, TEXTS, documents

PLAIN = (
    "The cat of the house is in the garden and it was with a dog that is for the day on as be by to "
    "run and to play in a field of grass, and the sun was on it. "
) * 12
_name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i + 1000))
PROSE = " ".join(f"{w} {_name(i)}" for i, w in enumerate(PLAIN.split()))
TABLE = "".join(f"| w{i}x | q{i} | {i * 37} | $ % & * # |\n" for i in range(120))


def signals(text):
    text = text or ""
    words = SPACED.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r["q"] for r in quality.judge(documents(spark, rows), into="q").collect()}
    for i, t, _ in rows:
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == signals(t), i
        failed = q["n_words"] < 20 or 100 * q["n_repeat_words"] > 30 * q["n_words"]
        assert q["base_failed"] == failed
        assert not (failed and q["kept"])


def test_distances_tell_junk_from_prose(spark):
    prose = PROSE
    rows = [(1, prose, "en"), (2, TABLE, "en"), (3, prose, None), (4, prose, "xx"), (5, "short but fine " * 1, "en")]
    got = {r["doc_id"]: r["q"] for r in quality.judge(documents(spark, rows), into="q").collect()}
    assert got[1]["char_distance"] < 0.15 + 1.6 / len(prose) ** 0.5 and got[2]["char_distance"] > 0.15 + 1.6 / len(TABLE) ** 0.5
    assert got[2]["word_distance"] > got[1]["word_distance"]
    assert not got[2]["kept"]
    for i in (3, 4):
        assert got[i]["char_distance"] is None and got[i]["word_distance"] is None and got[i]["kept"] != got[i]["base_failed"]
    assert got[5]["char_distance"] is None  # below the guard


def test_distance_is_jensen_shannon(spark):
    import math

    from pyspark.sql import functions as F

    from motiflake.llm.columns import js_distance

    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    got = spark.range(1).select(js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def test_references_are_those_of_the_corpus(spark):
    """Pooled counts of the texts that are near the seeds, whatever junk stands beside them and however rows are dealt out."""
    rows = [(i, PROSE[i:], "en") for i in range(6)] + [(10 + i, TABLE, "en") for i in range(20)] + [(40, "kurz", "de"), (41, None, "en"), (42, PLAIN, "xx")]
    df = documents(spark, rows)
    got = quality.references(df)
    assert got["de"] == quality.SEEDS["de"]
    near = [t for _, t, lang in rows[:6]]
    chars = [sum(map(len, near)) - sum(len(re.findall(p, t)) for t in near for p in quality.RARE_CLASSES)]
    chars += [sum(len(re.findall(p, t)) for t in near) for p in quality.RARE_CLASSES]
    words = [w.lower() for t in near for w in SPACED.findall(t)]
    own = quality.COMMON_WORDS["en"].split()
    common = [words.count(w) for w in own]
    common.append(len(words) - sum(common))
    for counts, seed, weight, have in zip((chars, common), quality.SEEDS["en"], (quality.SEED_CHARS, quality.SEED_WORDS), got["en"]):
        assert have == pytest.approx([(n + weight * s) / (sum(counts) + weight) for n, s in zip(counts, seed)])
    assert quality.references(df.repartition(3, "text")) == got
    assert quality.references(df.limit(0)) == quality.SEEDS


def test_empty_table(spark):
    assert quality.judge(documents(spark, [])).count() == 0
