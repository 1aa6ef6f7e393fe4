"""Quality rules: how far a text's character classes and common words are from those of its language.

A language's references are measured on the corpus itself, in one pass: texts that are long enough and near the seeds below are
added up, whole counts by language, so what comes to the driver is a row for each of four languages and does not depend
on how the input is dealt out. The seeds count as a short text more, so a corpus without a language is judged by them. The
second pass judges each row by itself: column expressions, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import WORD, js_distance, let

# The most frequent function words of each language, commonest first.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by",
    "de": "der die und in den von zu das mit sich des auf für ist im dem",
    "fr": "de la le et les des en un du une que est pour qui dans par",
    "es": "de la que el en y a los se del las un por con no una",
}
# Seeds of the references. Share of a text's characters that are lower-case ASCII letters, capitals, digits, white space,
# sentence marks, other ASCII marks, and anything beyond ASCII.
CHAR_SHARES = {
    "en": (0.790, 0.025, 0.005, 0.155, 0.023, 0.002, 0.000),
    "de": (0.795, 0.040, 0.005, 0.120, 0.023, 0.002, 0.015),
    "fr": (0.755, 0.025, 0.005, 0.150, 0.028, 0.002, 0.035),
    "es": (0.770, 0.025, 0.005, 0.150, 0.025, 0.002, 0.023),
}
#: Share of all words that the common ones make up in the seeds; Zipf's law shares it out among them.
COMMON_SHARE = 0.30
#: How many characters and words the seeds count as.
SEED_CHARS, SEED_WORDS = 10_000, 2_000

SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"
#: Runs of characters of the commonest class, with white space and controls.
COMMON_RUNS = r"[a-z\x00-\x20\x7F]+"
RARE_CLASSES = (r"[A-Z]", r"[0-9]", SPACE, r"[.,;:!?'\"()\-]", r"[#*$%&|<>+/=@\[\]^_`{}~\\]", r"[^\x00-\x7F]")


def common_shares(n: int, share: float = COMMON_SHARE) -> list[float]:
    """Shares of n ranked words and of all others, by Zipf's law."""
    total = sum(1 / k for k in range(1, n + 1))
    return [share / k / total for k in range(1, n + 1)] + [1 - share]


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words lie in windows of that many words that occur twice or more. Windows are compared by a
    64-bit hash, joined from hashes of 1, 2, 4 words and so on; only a text with a repeated one pays for the sort."""
    def joined(h: Column, reach: int) -> Column:
        if reach == window:
            return h
        pairs = F.transform(F.slice(h, 1, F.size(h) - reach), lambda x, i: F.xxhash64(x, F.get(h, i + reach)))
        return let(pairs, lambda wider: joined(wider, 2 * reach))

    if window & (window - 1):
        raise ValueError("window must be a power of two")
    singles = F.transform(words, lambda w: F.xxhash64(w))
    hashes = F.when(F.size(words) >= window, let(singles, lambda h: joined(h, 1))).otherwise(
        F.array().cast("array<bigint>")
    )

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1), x + window) - x))
        return F.aggregate(step, F.lit(0), lambda s, x: s + x)

    def twins(ranked: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            same = lambda k: F.coalesce(F.get(ranked, k)["h"] == x["h"], F.lit(False))
            return same(j - 1) | same(j + 1)

        return F.sort_array(F.transform(F.filter(ranked, twin), lambda x: x["i"]))

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(ranked, twins), covered)
        )

    return let(hashes, count)


def _by_lang(lang: Column, value, otherwise: Column) -> Column:
    out = None
    for name in COMMON_WORDS:
        out = (F.when if out is None else out.when)(lang == name, value(name))
    return out.otherwise(otherwise)


#: For each language the shares of its character classes and of its common words, with all others as one bin.
References = dict[str, tuple[list[float], list[float]]]
SEEDS: References = {name: (list(CHAR_SHARES[name]), common_shares(len(ws.split()))) for name, ws in COMMON_WORDS.items()}
_LISTED = max(len(ws.split()) for ws in COMMON_WORDS.values())


def _count(t: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))


def _chars(t: Column, words: Column) -> Column:
    """Counts of the character classes, in the order of ``CHAR_SHARES``. White space is what is in no word; the other rare
    classes are counted in what is left once runs of common characters are taken out."""
    space = F.char_length(t) - F.aggregate(words, F.lit(0), lambda s, w: s + F.char_length(w))

    def counted(rest: Column) -> Column:
        caps, digits, _, *others = (_count(rest, p) for p in RARE_CLASSES)
        rare = F.array(caps, digits, space, *others)
        return let(rare, lambda c: F.concat(F.array(F.char_length(t) - F.aggregate(c, F.lit(0), lambda a, b: a + b)), c))

    return let(F.regexp_replace(t, COMMON_RUNS, ""), counted)


def _common(words: Column, lang: Column) -> Column:
    """How often each common word of the language stands among words, and how often any other."""

    def of(name: str) -> Column:
        own = COMMON_WORDS[name].split()
        hits = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(own))
        counts = let(hits, lambda h: F.transform(F.array(*map(F.lit, own)), lambda x: F.size(F.filter(h, lambda y: y == x))))
        return let(counts, lambda c: F.concat(c, F.array(F.size(words) - F.aggregate(c, F.lit(0), lambda a, b: a + b))))

    return _by_lang(lang, of, F.lit(None).cast("array<int>"))


def _distance(counts: Column, lang: Column, references: References, which: int) -> Column:
    """From counts to the language's reference; null for a language without one."""
    total = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    shares = let(total, lambda n: F.transform(counts, lambda c: c / F.greatest(n, F.lit(1))))
    return let(shares, lambda p: _by_lang(lang, lambda name: js_distance(p, F.array(*map(F.lit, references[name][which]))), F.lit(None).cast("double")))


def references(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_char_distance: float = 0.15,
    char_slack: float = 1.6,
    max_word_distance: float = 0.38,
    min_chars: int = 400,
    min_words: int = 80,
) -> References:
    """The references that the corpus gives: pooled counts of all texts of a language that reach both guards and are as near to
    its seeds as :func:`judge` asks for, the seeds added as ``SEED_CHARS`` characters and ``SEED_WORDS`` words."""
    told = docs.filter(F.col(lang).isin(*COMMON_WORDS)).select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def measured(words: Column) -> Column:
        return F.struct(_chars(F.col("t"), words).alias("chars"), _common(words, F.col("lang")).alias("common"), F.size(words).alias("n"))

    def near(m: Column) -> Column:
        limit = max_char_distance + char_slack / F.sqrt(F.greatest(F.char_length("t"), F.lit(1)))
        close = (_distance(m["chars"], F.col("lang"), SEEDS, 0) <= limit) & (_distance(m["common"], F.col("lang"), SEEDS, 1) <= max_word_distance)
        return (m["n"] >= min_words) & close

    # a list of one text's counts or none: what a generator makes is worked out once, while a filter's columns would be twice
    counts = F.transform(F.array(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))), measured)
    rows = told.filter(F.char_length("t") >= min_chars).select("lang", F.explode(F.filter(counts, near)).alias("m"))
    bins = [F.sum(F.get(F.col("m.chars"), F.lit(i))).alias(f"c{i}") for i in range(len(RARE_CLASSES) + 1)]
    bins += [F.sum(F.coalesce(F.get(F.col("m.common"), F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(_LISTED + 1)]
    pooled = rows.groupBy("lang").agg(*bins)
    out = dict(SEEDS)
    for r in pooled.collect():  # a row for each language
        chars, words = SEEDS[r["lang"]]
        c, w = [r[f"c{i}"] for i in range(len(chars))], [r[f"w{i}"] for i in range(len(words))]
        out[r["lang"]] = (
            [(n + SEED_CHARS * s) / (sum(c) + SEED_CHARS) for n, s in zip(c, chars, strict=True)],
            [(n + SEED_WORDS * s) / (sum(w) + SEED_WORDS) for n, s in zip(w, words, strict=True)],
        )
    return out


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_char_distance: float = 0.15,
    char_slack: float = 1.6,
    max_word_distance: float = 0.38,
    min_chars: int = 400,
    min_words: int = 80,
    min_base_words: int = 20,
    max_repeat_percent: int = 30,
    into: str = "quality",
    known: References | None = None,
) -> DataFrame:
    """docs with a column ``into``, a struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    char_distance, word_distance (double), base_failed, kept (boolean).

    char_distance compares seven character classes with the language's, word_distance the common words (and all
    others as one bin); both are Jensen-Shannon distances, 0 to 1, from references that are ``known`` or else measured on
    docs by :func:`references`. A text is rejected if base_failed or if a distance is over its limit. What chance adds to a
    distance falls with the root of the length, so the limit of char_distance is max_char_distance and char_slack over the root of
    the characters. Guards: a distance counts only from ``min_chars`` characters or ``min_words`` words on; below, it is
    null. It is null too where the language is null or has no reference, and such a text is judged by the base alone. A null
    or empty text has no words, so base_failed. Rows are judged one by one: ties, repeats and other columns don't matter; a
    column named as ``into`` is replaced.
    """
    refs = known or references(docs, text, lang, max_char_distance, char_slack, max_word_distance, min_chars, min_words)
    body = F.coalesce(F.col(text), F.lit(""))
    spoken = F.col(lang)

    def lines(t: Column) -> Column:
        with_words = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        return let(with_words, lambda a: F.size(a) - F.size(F.array_distinct(a)))

    def of_words(words: Column) -> Column:
        far = let(_common(words, spoken), lambda c: _distance(c, spoken, refs, 1))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.when((F.size(words) >= min_words) & spoken.isin(*COMMON_WORDS), far).alias("word_distance"),
        )

    def of_chars(t: Column, words: Column) -> Column:
        n = F.char_length(t)
        return let(
            _chars(t, words),
            lambda c: F.struct(
                (n - F.get(c, F.lit(3))).cast("long").alias("word_chars"),
                F.when((n >= min_chars) & spoken.isin(*CHAR_SHARES), _distance(c, spoken, refs, 0)).alias("char_distance"),
                (max_char_distance + char_slack / F.sqrt(F.greatest(n, F.lit(1)))).alias("limit"),
            ),
        )

    def verdict(w: Column, c: Column, symbols: Column, dup: Column) -> Column:
        failed = (w["n_words"] < min_base_words) | (100 * w["n_repeat_words"] > max_repeat_percent * w["n_words"])
        far = F.coalesce(c["char_distance"] > c["limit"], F.lit(False)) | F.coalesce(
            w["word_distance"] > max_word_distance, F.lit(False)
        )
        return F.struct(
            w["n_words"].alias("n_words"),
            c["word_chars"].alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            c["char_distance"].alias("char_distance"),
            w["word_distance"].alias("word_distance"),
            failed.alias("base_failed"),
            (~failed & ~far).alias("kept"),
        )

    def measured(t: Column) -> Column:
        def told(words: Column) -> Column:
            return let(of_words(words), lambda w: let(of_chars(t, words), lambda c: verdict(w, c, _count(t, SYMBOLS), lines(t))))

        return let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), told)

    return docs.withColumn(into, let(body, measured))
