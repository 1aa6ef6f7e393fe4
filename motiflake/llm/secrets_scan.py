"""Secret scans: fixed patterns, and the guess cost of values that stand in a credential's place.

The guess cost is the least sum, over all ways to cut a value into words, dates, repeats, keyboard walks and
brute-force spans, of the decimal logarithms of the guesses that each part takes. Every value in a credential's place is
judged by it, whatever other pattern holds the value too: over the limit it is a secret, and one that a few guesses
find (``changeme``, ``token: the``) is not. The program is linear in the value's length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textscan import pieces

# The patterns of the base and the least length of what they catch.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "guess")

#: Values in a credential's place: behind a telling name and a sign, in a url's userinfo, behind ``Bearer``, in a key block.
_GAP = r"[\x09-\x0D\x20]*"
CONTEXTS = (
    re.compile(
        r"""(?:password|passwd|passphrase|passcode|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?"""
        r"""|(?<![A-Za-z0-9])(?:pass|pwd|pin|auth|login))["']?"""
        + _GAP
        + "[:=]"
        + _GAP
        + r"""["']?([^\x09-\x0D\x20"'<>|,;]{4,})""",
        re.IGNORECASE | re.ASCII,
    ),
    re.compile(r"""://[^\x09-\x0D\x20/:@"'<>]*:([^\x09-\x0D\x20/@"'<>]{4,})@"""),
    re.compile(r"(?<![A-Za-z0-9])bearer[\x09-\x0D\x20]+([A-Za-z0-9+/_.=~-]{8,})", re.IGNORECASE | re.ASCII),
    re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\x09-\x0D\x20]*([A-Za-z0-9+/=\x09-\x0D\x20]{4,})-----END"),
)
#: What a text must hold for any pattern to match; run over whole columns first.
ANY = (
    r"""(?i:pass|passwd|password|passphrase|passcode|pwd|pin|secret|token|key|auth|credentials?|login)["']?[\x09-\x0D\x20]*[:=]"""
    r"""|AKIA[A-Z0-9]|[0-9a-f]{16}|://[^\x09-\x0D\x20/:@]*:[^\x09-\x0D\x20/@]+@|(?i:bearer)[\x09-\x0D\x20]|PRIVATE KEY-----"""
)

# Words that guesses try first, commonest first.
COMMON = (
    "password the letmein admin welcome monkey dragon master login secret changeme example test user root guest "
    "hello abc love iloveyou sunshine princess football baseball shadow superman batman trustno access pass token key "
    "none null true false default your here value string insert xxxx todo foo bar baz demo sample temp new old my "
    "and of to in is that for was on with as be by a it winter summer spring autumn january monday london paris"
).split()
_RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
_LONGEST_WORD = max(map(len, COMMON))
_FIRST = frozenset(w[0] for w in COMMON)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The longest word or date.
_REACH = 14
# The rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_KEY = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
#: For two keys that touch, written one after the other, the direction from the one to the other.
_STEP = {
    a + b: (r2 - r1, i2 - i1)
    for a, (r1, i1) in _KEY.items()
    for b, (r2, i2) in _KEY.items()
    if a != b and abs(r1 - r2) <= 1 and abs(i1 - i2) <= 1
}
#: How far back a repeat may copy from.
UNITS = 8
#: What a cut between two parts costs, and a walk's length or a repeat's count.
_CUT, _COUNT = math.log10(2), 1.0
#: Into a walk: its first key; each change of direction: which one. Into a repeat: how far back.
_WALK, _TURN, _COPY = math.log10(len(_KEY)) + _COUNT, math.log10(8), math.log10(UNITS) + _COUNT
_DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
)
#: Letters in one case, or with a capital first, that could be a word of some language: one of 100,000.
_WORDLIKE = re.compile(r"[A-Za-z][a-z]{2,13}(?![a-z])|[A-Z]{3,14}(?![A-Z])")
_VOWELS = frozenset("aeiouyAEIOUY")
_YEAR = re.compile(r"(?:19|20)\d\d")


def _brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else math.log10(200)


def _spans(value: str, low: str, i: int) -> Iterator[tuple[int, float]]:
    """Words and dates that begin at i: where each ends and what it costs. None is longer than ``_REACH``."""
    c = value[i]
    if c.isdigit():
        if m := _DATE.match(value, i):
            yield m.end(), math.log10(366 * 120) + (0.6 if m[1] or m[2] else 0)
        if m := _YEAR.match(value, i):
            yield m.end(), math.log10(120)
        return
    if low[i] in _FIRST:
        for j in range(i + 1, min(len(value), i + _LONGEST_WORD) + 1):
            if rank := _RANK.get(low[i:j]):
                upper = sum(x.isupper() for x in value[i:j])
                yield j, math.log10(rank + 1) + (math.log10(2 * min(upper, j - i - upper) + 2) if upper else 0)
    if c.isascii() and c.isalpha() and (m := _WORDLIKE.match(value, i)) and 0.2 <= sum(x in _VOWELS for x in m[0]) / len(m[0]) <= 0.7:
        yield m.end(), 5.0


def guess_cost(value: str, limit: float = math.inf) -> float:
    """Decimal logarithm of the guesses that the cheapest way to cut value into parts takes, or a lower bound of it that is
    ``limit`` or more.

    A part is a word, a date, a keyboard walk, a repeat (a run of characters that copies what stands up to ``UNITS``
    before) or brute force. Walks and repeats are states that a character more extends, so the time is linear.
    """
    n, low = len(value), value.translate(_LOWER)
    best = [0.0] + [math.inf] * n
    first, walk, step = math.inf, math.inf, None  # walks of one key and of more, and the last step's direction
    copies = [math.inf] * (UNITS + 1)
    for i in range(n):
        c, here = value[i], best[i]
        cut = _CUT if i else 0.0
        now = _STEP.get(low[i - 1 : i + 1]) if i else None
        walk = math.inf if now is None else min(first + _TURN, walk + (0.0 if now == step else _TURN))
        first, step = (here + cut + _WALK if low[i] in _KEY else math.inf), now
        least = min(best[i + 1], here + _brute(c), walk)
        for u in range(1, min(UNITS, i) + 1):
            if c == value[i - u]:
                copies[u] = min(copies[u], here + _CUT + _COPY)
                least = min(least, copies[u])
            else:
                copies[u] = math.inf
        best[i + 1] = least
        for j, cost in _spans(value, low, i):
            best[j] = min(best[j], here + cut + cost)
        if best[i + 1] >= limit and first >= limit and (floor := min(best[i + 1 : i + 1 + _REACH])) >= limit:
            return min(floor, first)
    return best[n]


@lru_cache(maxsize=1 << 14)
def _short_cost(value: str, limit: float) -> float:
    return guess_cost(value, limit)


def find(text: str, limit: float = 8.0) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a text in code points, by start and then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    costly = set()
    for context in CONTEXTS:
        for m in context.finditer(text):
            value = m[1].rstrip(".:!?)]}\t\n\v\f\r ")
            cost = _short_cost if len(value) <= 64 else guess_cost
            if len(value) >= 4 and cost(value, limit) >= limit:
                costly.add(("guess", m.start(1), m.start(1) + len(value)))
    return sorted([*out, *costly], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(
    docs: DataFrame, text: str = "text", into: str = "secrets", limit: float = 8.0, mask: str | None = None
) -> DataFrame:
    """docs with a column ``into``: array<struct<kind, start, end>>, in code points, end exclusive, by start and then kind.

    Kinds assign, access and hex are the base's patterns, leftmost and not overlapping per kind, with matches too short
    dropped. Kind guess is a value in a credential's place (``CONTEXTS``) whose guess cost is ``limit`` or more, also where
    a base span holds it. With ``mask``, the text has every span (those that overlap as one) replaced by it. A null or empty text has no
    spans and stays as it is. Rows are scanned one by one: ties, repeats and nulls elsewhere don't matter; a column named
    as ``into`` is replaced.
    """
    docs = docs.drop(into) if into in docs.columns else docs
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField(
                into,
                T.ArrayType(
                    T.StructType(
                        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
                    )
                ),
            ),
        ]
    )
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts = batch.column(text)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            changed: dict[int, str] = {}
            maybe = pc.fill_null(pc.match_substring_regex(texts, ANY), False)
            for i in pc.indices_nonzero(maybe).to_pylist():
                body = texts[i].as_py()
                if found := find(body, limit):
                    spans[i] = [{"kind": k, "start": a, "end": b} for k, a, b in found]
                    if mask is not None:
                        changed[i] = redact(body, found, mask)
            columns = batch.columns
            if changed:
                at = batch.schema.get_field_index(text)
                mask_of = pa.array([i in changed for i in range(batch.num_rows)])
                columns[at] = pc.replace_with_mask(texts, mask_of, pa.array(list(changed.values()), texts.type))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def joined(spans: F.Column) -> F.Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
