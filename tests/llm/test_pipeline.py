import math
import random
import re

import sentencepiece

import corpus_pipeline
from motiflake.llm import piece, quality, secrets_scan

from .helpers import SPACED
from .test_decontam import brute as decontaminated
from .test_minhash import brute as grouped
from .test_quality import signals


def distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    half = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, (half(p) + half(q)) / 2))


def histograms(text, lang):
    counts = [len(re.findall(p, text)) for p in quality.RARE_CLASSES]
    words = [w.lower() for w in SPACED.findall(text)]
    common = [words.count(w) for w in quality.COMMON_WORDS[lang].split()]
    return [len(text) - sum(counts), *counts], [*common, len(words) - sum(common)]


def shares(counts):
    return [c / sum(counts) for c in counts]


def near(text, lang, references):
    """Whether the two distances, each where its guard is reached, are within their limits."""
    chars, common = histograms(text, lang)
    if len(text) >= 400 and distance(shares(chars), references[lang][0]) > 0.15 + 1.6 / len(text) ** 0.5:
        return False
    return sum(common) < 80 or distance(shares(common), references[lang][1]) <= 0.38


def measured(docs):
    out = dict(quality.SEEDS)
    for lang in out:
        own = [histograms(t, lang) for _, t, own in docs if own == lang and t and len(t) >= 400 and len(SPACED.findall(t)) >= 80 and near(t, lang, quality.SEEDS)]
        mixed = []
        for k, weight in enumerate((quality.SEED_CHARS, quality.SEED_WORDS)):
            total = [sum(x) for x in zip(*(h[k] for h in own))] or [0] * len(quality.SEEDS[lang][k])
            mixed.append([(n + weight * s) / (sum(total) + weight) for n, s in zip(total, quality.SEEDS[lang][k])])
        out[lang] = tuple(mixed)
    return out


def good(text, lang, references):
    n, _, _, _, repeated = signals(text)
    if n < 20 or 100 * repeated > 30 * n:
        return False
    return lang not in quality.COMMON_WORDS or near(text, lang, references)


def brute(docs, items):
    library = sentencepiece.SentencePieceProcessor(model_file=piece.default_model())
    references = measured(docs)
    kept = [(i, t or "", lang) for i, t, lang in docs if good(t or "", lang, references)]
    label, _ = grouped(kept, 5, 80)
    kept = [r for r in kept if label[r[0]] == r[0]]
    kept = [r for r in kept if not decontaminated(r[1], items)[1]]
    out = {}
    for i, t, _ in kept:
        out[i] = library.encode(secrets_scan.redact(t, secrets_scan.find(t), corpus_pipeline.MASK), add_eos=True)
    return out


def corpus():
    rng = random.Random(8)
    common = quality.COMMON_WORDS["en"].split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.35 else f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}ing" for _ in range(n))
    items = [(i, " ".join(f"item{rng.randint(0, 900)}" for _ in range(18))) for i in range(5)]
    docs, n = [], 0
    for _ in range(40):
        base = prose(rng.randint(25, 300))
        docs.append((n, base, "en"))
        n += 1
        for _ in range(rng.randint(0, 3)):
            words = base.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "changed"
            docs.append((n, " ".join(words), "en"))
            n += 1
    for k in range(6):
        docs += [(n, prose(60) + " " + items[k % 5][1] + " " + prose(30), "en"), (n + 1, prose(60) + f' password = "aB{k}$xQ9!zzR4tT" ' + prose(9), "en")]
        docs += [(n + 2, "| # | $ | % |\n" * 60, "en"), (n + 3, "too short", "en"), (n + 4, prose(90), None)]
        n += 5
    docs += [(n, None, None), (n + 1, "", "de")]
    return docs, items


def test_against_plain_python(spark, tmp_path):
    docs, items = corpus()
    full = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    full.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == brute(docs, items)
    assert 30 < len(got) < len(docs) - 20


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).schema == df.schema, name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
    masked = corpus_pipeline.mask_secrets(spark, df, str(tmp_path)).filter("text like '%[SECRET]%'").collect()
    assert masked and all(r["n_chars"] == len(r["text"]) for r in masked)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"]
