"""Personal data behind format-preserving pseudonyms.

Numbers and dates that pass their check (Luhn digit, mod 97, calendar, ranges) and e-mail names are permuted by a keyed Feistel
network within their own format: a card number becomes another valid card number with the same separators. The
same value becomes the same pseudonym in every document, so links between documents stay. Only SQL functions
are used; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, unused

ROUNDS = 5
#: Symbols that one network permutes; longer strings go in pieces.
CHUNK = 24
# What may be personal data. A pattern begins only where no earlier part of the same run could.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}"
# The length of a country's IBANs, so that a word or number behind one is not taken for its end.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _of_length(n: int, lands: str) -> str:
    fours, rest = divmod(n - 4, 4)
    return f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


IBAN = (
    r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
    + "|".join(_of_length(n, lands) for n, lands in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
)
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.\-][0-9])"
CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = (
    r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-][0-9]{3,4}|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4})(?![0-9])"
)
PATTERN = "|".join((EMAIL, IBAN, DATE, IP, SSN, PHONE, CARD))
KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")
#: Days of the years 1800 to 2199 (one whole turn of the calendar) as two factors, and the first of them.
DAY_FACTORS, FIRST_DAY = (627, 233), "1800-01-01"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def network(left: Column, right: Column, n_left: Column, n_right: Column, key: str, kind: str) -> Column:
    """struct<a, b>: the pair (left, right) permuted among all pairs below (n_left, n_right)."""

    def draw(turn: Column, side: str, x: Column) -> Column:
        told = F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(side), turn, n_left, n_right, x)
        return F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("long")

    def both(s: Column, turn: Column) -> Column:
        return let(
            (s["a"] + draw(turn, "a", s["b"])) % n_left,
            lambda a: F.struct(a.alias("a"), ((s["b"] + draw(turn, "b", a)) % n_right).alias("b")),
        )

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, both)


def _number(symbols: Column, letters: bool) -> Column:
    if not letters:
        return F.coalesce(F.nullif(symbols, F.lit("")).cast("long"), F.lit(0).cast("long"))
    each = F.filter(F.split(symbols, ""), lambda c: c != "")
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, c: s * 26 + F.ascii(c) - 97)


def _symbols(number: Column, width: Column, letters: bool) -> Column:
    if not letters:
        return F.when(width > 0, F.lpad(number.cast("string"), width, F.lit("0"))).otherwise(F.lit(""))
    state = F.struct(number.alias("n"), F.lit("").alias("out"))
    step = lambda s, _: F.struct(
        F.call_function("div", s["n"], F.lit(26).cast("long")).alias("n"),
        F.concat(F.substring(F.lit(_LETTERS), (s["n"] % 26 + 1).cast("int"), F.lit(1)), s["out"]).alias("out"),
    )
    return F.when(
        width > 0, F.aggregate(F.sequence(F.lit(1), width), state, step, lambda s: s["out"])
    ).otherwise(F.lit(""))


def permute(symbols: Column, key: str, kind: str, letters: bool = False) -> Column:
    """A string of digits, or of small letters, as another one of its length."""
    radix = 26 if letters else 10

    def piece(s: Column) -> Column:
        n = F.char_length(s)
        u = F.floor(n / 2).cast("int")
        power = lambda w: F.when(w > 0, F.pow(F.lit(float(radix)), w)).otherwise(F.lit(1.0)).cast("long")
        made = network(
            _number(F.substring(s, F.lit(1), u), letters),
            _number(F.substring(s, u + 1, n), letters),
            power(u),
            power(n - u),
            key,
            f"{kind}{radix}",
        )
        return let(made, lambda m: F.concat(_symbols(m["a"], u, letters), _symbols(m["b"], n - u, letters)))

    at = F.sequence(F.lit(1), F.greatest(F.char_length(symbols), F.lit(1)), F.lit(CHUNK))
    parts = F.transform(at, lambda i: let(F.substring(symbols, i, F.lit(CHUNK)), piece))
    return F.when(symbols == "", symbols).otherwise(F.array_join(parts, ""))


def _refill(shape: Column, pattern: str, fill: Column) -> Column:
    """shape with its characters of a class replaced by those of fill, in order; capitals stay capitals."""

    def step(s: Column, c: Column) -> Column:
        new = F.substring(fill, s["i"] + 1, F.lit(1))
        cased = F.when(c.rlike("^[A-Z]$"), F.upper(new)).otherwise(new)
        hit = c.rlike(pattern)
        return F.struct(
            F.when(hit, s["i"] + 1).otherwise(s["i"]).alias("i"),
            F.concat(s["out"], F.when(hit, cased).otherwise(c)).alias("out"),
        )

    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step, lambda s: s["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(iban: Column) -> Column:
    """Remainder of an IBAN without spaces, its first four characters moved to the end."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))
    each = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(
        each, F.lit(0), lambda s, c: (s * F.when(c.rlike("^[0-9]$"), F.lit(10)).otherwise(F.lit(100)) + value(c)) % 97
    )


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    letters = permute(F.regexp_replace(F.lower(name), "[^a-z]", ""), key, "email", letters=True)
    digits = permute(_digits(name), key, "email")
    return F.concat(
        _refill(_refill(name, "^[0-9]$", digits), "^[A-Za-z]$", letters),
        F.substring(m, F.char_length(name) + 1, F.char_length(m)),
    )


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))

    def made(p: Column) -> Column:
        body = F.substring(p, F.lit(5), F.char_length(p))
        new = _refill(body, "^[0-9]$", permute(_digits(body), key, "iban"))
        land = F.substring(p, 1, 2)
        full = let(
            new,
            lambda b: F.concat(
                land, F.lpad((98 - _mod97(F.concat(land, F.lit("00"), b))).cast("string"), 2, "0"), b
            ),
        )
        return _refill(m, "^[A-Z0-9]$", full)

    return let(plain, lambda p: F.when((F.char_length(p) >= 15) & (_mod97(p) == 1), made(p)))


def _date(m: Column, key: str) -> Column:
    def shifted(form: str) -> Column:
        day = F.to_date(F.try_to_timestamp(m, F.lit(form)))
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        a, b = DAY_FACTORS
        made = network(F.floor(n / b), n % b, F.lit(a).cast("long"), F.lit(b).cast("long"), key, "date")
        moved = let(made, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x["a"] * b + x["b"]).cast("int")))
        return F.when((n >= 0) & (n < a * b), F.date_format(moved, form))

    dotted, slashed = m.contains("."), m.contains("/")
    return (
        F.when(dotted, shifted("dd.MM.yyyy"))
        .when(slashed, F.coalesce(shifted("dd/MM/yyyy"), shifted("MM/dd/yyyy")))
        .otherwise(shifted("yyyy-MM-dd"))
    )


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    half = F.lit(1 << 16).cast("long")

    def made(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        new = network(at(0) * 256 + at(1), at(2) * 256 + at(3), half, half, key, "ip")
        dotted = lambda x: F.concat_ws(".", F.floor(x / 256), x % 256)
        return F.when(F.array_max(p) < 256, let(new, lambda x: F.concat_ws(".", dotted(x["a"]), dotted(x["b"]))))

    return let(parts, made)


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = permute(F.substring(d, F.lit(1), F.char_length(d) - 1), key, "card")
        check = lambda b: F.get(
            F.filter(
                F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(b, c.cast("string"))),
                lambda x: F.call_function("luhn_check", x),
            ),
            F.lit(0),
        )
        return F.when(F.call_function("luhn_check", d), _refill(m, "^[0-9]$", let(body, check)))

    return let(_digits(m), made)


def _front(m: Column) -> Column:
    """The longest valid card number at the front of a match that is none as a whole and has other digits behind it; else null.
    It ends where a run of digits does."""
    ends = F.filter(
        F.sequence(F.char_length(m) - 1, F.lit(13), F.lit(-1)), lambda n: F.substring(m, n, F.lit(2)).rlike("^[0-9][ -]$")
    )
    fronts = F.transform(ends, lambda n: F.substring(m, F.lit(1), n))
    valid = F.filter(fronts, lambda c: c.rlike(_whole(CARD)) & F.call_function("luhn_check", _digits(c)))
    return F.when(m.rlike(_whole(CARD)) & (F.char_length(m) > 13), F.get(valid, F.lit(0)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays."""
    land = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .\-(])", 0)
    rest = F.substring(m, F.char_length(land) + 1, F.char_length(m))
    own = lambda r: let(
        _digits(r),
        lambda d: F.when(F.char_length(d).between(7, 15), F.concat(land, _refill(r, "^[0-9]$", permute(d, key, "phone")))),
    )
    return let(rest, own)


def _ssn(m: Column, key: str) -> Column:
    valid = ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return F.when(valid, _refill(m, "^[0-9]$", permute(_digits(m), key, "ssn")))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", into: str = "pseudonyms") -> DataFrame:
    """docs with its text pseudonymised, and a column ``into``: array<struct<kind, value>> of the pseudonyms put in, in order.

    ``key`` is the secret that decides the permutation. What looks like personal data but fails its check stays as it is, but for
    a valid card number at the front of a longer run; behind it, the text up to the next match is searched once more.
    A null text stays null with no pseudonyms; rows are handled one by one, so ties, repeats and nulls elsewhere
    don't matter. A column named as ``into`` is replaced.
    """
    made: dict[str, Callable[[Column, str], Column]] = {
        "email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card,
    }
    shapes = {"email": EMAIL, "iban": IBAN, "date": DATE, "ip": IP, "ssn": SSN, "phone": PHONE, "card": CARD}

    def one(m: Column) -> Column:
        """struct<kind, value, tail>: tail is what a match has behind a valid card number at its front."""
        tried = [
            F.when(m.rlike(_whole(shapes[k])), made[k](m, key)).alias("value") for k in KINDS
        ]
        left = lambda front: F.when(
            front.isNotNull(),
            F.struct(F.lit("card").alias("kind"), _card(front, key).alias("value"), F.substring(m, F.char_length(front) + 1, F.char_length(m)).alias("tail")),
        ).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"), F.lit("").alias("tail")))
        return let(
            F.array(*tried),
            lambda t: let(
                F.get(F.filter(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda i: F.get(t, i).isNotNull()), F.lit(0)),
                lambda i: F.when(
                    i.isNotNull(),
                    F.struct(F.get(F.array(*map(F.lit, KINDS)), i).alias("kind"), F.get(t, i).alias("value"), F.lit("").alias("tail")),
                ).otherwise(let(_front(m), left)),
            ),
        )

    searched = lambda source: F.transform(F.regexp_extract_all(source, F.lit(PATTERN), F.lit(0)), one)
    split = lambda source: F.split(source, PATTERN, -1)
    told = lambda d: F.struct(d["kind"].alias("kind"), d["value"].alias("value"))
    done_, split_, gaps_, again_, new_ = (unused(docs, f"__pii_{n}") for n in ("done", "split", "gaps", "again", "new"))
    # step by step: matches, gaps with the tails before them, what is found in those gaps, and all put together
    rows = docs.withColumn(done_, searched(F.col(text))).withColumn(split_, split(F.col(text)))

    def gap(g: Column, i: Column) -> Column:
        tail = F.coalesce(F.get(done_, i - 1)["tail"], F.lit(""))
        return F.struct(F.concat(tail, g).alias("text"), (tail != "").alias("again"))

    rows = rows.withColumn(gaps_, F.transform(split_, gap))
    none = F.array().cast("array<struct<kind: string, value: string, tail: string>>")
    again = lambda w: F.when(w["again"], searched(w["text"])).otherwise(none)
    rows = rows.withColumn(again_, F.transform(gaps_, again))

    def woven(gaps: Column, values: Column) -> Column:
        return F.array_join(F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")

    def filled(w: Column, i: Column) -> Column:
        values = F.transform(F.get(again_, i), lambda d: F.concat(d["value"], d["tail"]))
        return F.when(w["again"], woven(split(w["text"]), values)).otherwise(w["text"])

    whole = woven(F.transform(gaps_, filled), F.transform(done_, lambda d: d["value"]))
    found = F.transform(
        again_, lambda n, i: F.transform(F.concat(n, F.slice(done_, i + 1, F.lit(1))), told)
    )
    found = F.filter(F.flatten(found), lambda d: d["kind"].isNotNull())
    new = F.struct(
        F.when(F.size(done_) > 0, whole).otherwise(F.col(text)).alias("text"), found.alias("found")
    )
    out = rows.withColumn(new_, F.when(F.col(text).isNotNull(), new)).drop(
        done_, split_, gaps_, again_
    )
    none = F.array().cast("array<struct<kind: string, value: string>>")
    return (
        out.withColumn(text, F.col(f"{new_}.text")).withColumn(into, F.coalesce(f"{new_}.found", none)).drop(new_)
    )
