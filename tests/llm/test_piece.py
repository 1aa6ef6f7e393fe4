import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from motiflake.llm import piece

from .helpers import TEXTS, documents


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece.default_model())


def same(library, texts):
    own = piece.codec(piece.default_model())
    ids, at = own.encode_batch(texts)
    decoded = own.decode_batch(ids, at)
    for i, t in enumerate(texts):
        want = library.encode(t, add_eos=True)
        assert ids[at[i] : at[i + 1]].tolist() == want, t[:80]
        assert decoded[i] == library.decode(want)


def test_known_texts(library):
    same(library, [t or "" for t in TEXTS] + ["▁", " ▁ ", "a" * 5000, " " * 70 + "x", "<s></s><0x41>", "\ufeffx", "the" * 400, "def f():\n        return 1\n"])


def test_random_mixes(library):
    rng = random.Random(3)
    alphabet = "aabcdeeethin ▁  \t\n0123456789<>x_/.=-éßñ中文字\U0001f600\x00ABCtheing"
    same(library, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    processor = sentencepiece.SentencePieceProcessor(model_file=piece.default_model())
    same(processor, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_forgets_and_goes_on(library, monkeypatch):
    monkeypatch.setattr(piece, "KEPT_WORDS", 50)
    rng = random.Random(9)
    for _ in range(5):
        same(library, [" ".join(f"w{rng.randint(0, 999)}" for _ in range(40))])


def test_dataframe(spark, library):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "no id", "en"), (1, "", "en")]
    got = piece.encode(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] not in (None, 1):
            assert r["ids"] == library.encode(TEXTS[r["doc_id"]] or "", add_eos=True)
    assert piece.encode(documents(spark, [])).count() == 0
