import random
import textwrap

import numpy as np

from motiflake.llm import licenses as li

from .helpers import TEXTS, documents, lettered


def brute(text):
    words = lettered(text)
    phrases = sorted((i, label) for p, label in li.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    blocks = []
    for label, t in li.TEMPLATES:
        want = set(lettered(t))
        width = len(lettered(t))
        spans = []
        for end in range(1, len(words) + 1):
            if words[end - 1] not in want:
                continue
            start = max(0, end - width)
            own = set(words[start:end]) & want
            if 100 * len(own) >= 80 * len(want):
                start = next(i for i in range(start, end) if words[i] in want)
                if spans and start < spans[-1][1]:
                    spans[-1] = (spans[-1][0], end, max(spans[-1][2], len(own)))
                else:
                    spans.append((start, end, len(own)))
        blocks += [(a, b, label, c, len(want)) for a, b, c in spans]
    return len(words), phrases, sorted(blocks)


def test_against_brute_force(spark):
    rng = random.Random(4)
    texts = list(TEXTS) + ["CC BY", "cc-by! cc\nby", "GNU general public\nlicense", "all rights, reserved all rights reserved"]
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = lettered(rng.choice(li.TEMPLATES)[1])
            rng.shuffle(words)
            keep = words[: rng.randint(len(words) // 2, len(words))] + ["foo"] * rng.randint(0, 3)
            lines.append(" ".join(keep))
        texts.append("\n".join(lines))
    texts += [wrapped(t, mark, at) for _, t in li.TEMPLATES for mark, at in (("# ", 30), (" * ", 12), ("", 60))]
    texts.append(" ".join(t for _, t in li.TEMPLATES) * 3)
    got = li.scan(documents(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()
    assert len(got) == len(texts)
    for r in got:
        n, phrases, blocks = brute(texts[r["doc_id"]])
        assert r["n_words"] == n
        assert [(p["start"], p["label"]) for p in r["phrases"]] == phrases
        assert sorted((b["start"], b["end"], b["label"], b["common"], b["size"]) for b in r["blocks"]) == blocks, r["doc_id"]


def wrapped(text, mark, at):
    return "".join(mark + line + "\n" for line in textwrap.wrap(text, at, break_long_words=False))


def test_wrapped_notices_are_found(spark):
    rows = [(i, "Some code.\n" + wrapped(t, "// ", 40) + "int main()", "en") for i, (_, t) in enumerate(li.TEMPLATES)]
    for r in li.scan(documents(spark, rows)).collect():
        assert li.TEMPLATES[r["doc_id"]][0] in {b["label"] for b in r["blocks"] if b["common"] == b["size"]}


def test_prefix_is_enough():
    """A block that meets the threshold holds a prefix word whatever the order of the words."""
    rng = random.Random(1)
    for _ in range(50):
        counts = {int(w): rng.randint(0, 9) for _, t in li.TEMPLATES for w in li._hashed(t)}
        for m in li.index(list(li.TEMPLATES), counts, 80):
            some = np.array(rng.sample(m.words.tolist(), m.need), np.uint64)
            assert li.match(m, some, np.zeros(len(some), np.int64), np.arange(len(some))) == [(0, m.need, m.need)]


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "cc by", "en"), (1, "cc by", "en"), (None, None, None)]
    assert sorted(len(r["phrases"]) for r in li.scan(documents(spark, rows)).collect()) == [0, 1, 1]
    assert li.scan(documents(spark, [])).count() == 0
