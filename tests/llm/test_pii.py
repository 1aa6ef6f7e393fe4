import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from motiflake.llm import pii

from .helpers import TEXTS, documents

FIND = {
    1: "mail the.72@mail3.example.com, or John_Smith+x@a.co",
    2: "card 4539 1488 0343 6467 and 4539148803436467 or 1234567890123456",
    3: "call +1 (017) 555-7713 now, (017) 555-7713",
    4: "ip 169.122.221.182 and 300.1.1.1 v1.2.3",
    5: "born 1987-03-14, 14/03/1987, 14.03.1987 or 2021-13-45 or 02/29/2000 or 02/30/2000",
    6: "ssn 123-45-6789 000-12-3456",
    7: "iban DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 GB83WEST12345698765432",
    8: "again the.72@mail3.example.com and 4539-1488-0343-6467",
}


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def run(spark, rows, key="k"):
    return {r["doc_id"]: r for r in pii.pseudonymise(documents(spark, rows), key).collect()}


def test_formats_and_checks(spark):
    got = run(spark, [(i, t, "en") for i, t in FIND.items()])
    kinds = {i: [p["kind"] for p in r["pseudonyms"]] for i, r in got.items()}
    assert kinds == {
        1: ["email"] * 2, 2: ["card"] * 2, 3: ["phone"] * 2, 4: ["ip"], 5: ["date"] * 4, 6: ["ssn"], 7: ["iban"] * 2, 8: ["email", "card"],
    }
    shape = lambda t: re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", t)))
    for i, r in got.items():
        if i not in (4, 7):
            assert shape(r["text"]) == shape(FIND[i]), i
        assert r["text"] != FIND[i]
    assert all(luhn(p["value"]) for p in got[2]["pseudonyms"])
    assert "1234567890123456" in got[2]["text"] and "300.1.1.1" in got[4]["text"] and "GB83WEST12345698765432" in got[7]["text"]
    for p in got[7]["pseudonyms"]:
        plain = p["value"].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_what_follows_a_number(spark):
    """A date, code or word behind a valid number does not hide it, nor does the number hide what follows."""
    texts = {
        1: "4111 1111 1111 1111 12/27 x",
        2: "4111111111111111 123",
        3: "AT61 1904 3002 3457 3201 BIC",
        4: "4111 1111 1111 1111 123-45-6789 x 4111-1111-1111-1111",
        5: "1234567890123456 12/27, AT62 1904 3002 3457 3201 BIC",
    }
    got = run(spark, [(i, t, "en") for i, t in texts.items()])
    kinds = {i: [p["kind"] for p in r["pseudonyms"]] for i, r in got.items()}
    assert kinds == {1: ["card"], 2: ["card"], 3: ["iban"], 4: ["card", "ssn", "card"], 5: []}
    assert got[5]["text"] == texts[5]
    for i in (1, 2):
        n = len(texts[i].split("1 12")[0]) + 1
        assert got[i]["text"][n:] == texts[i][n:] and got[i]["text"][:n] == got[i]["pseudonyms"][0]["value"] and luhn(got[i]["text"][:n])
    assert got[3]["text"] == got[3]["pseudonyms"][0]["value"] + " BIC"
    assert got[4]["text"] == "{} {} x {}".format(*(p["value"] for p in got[4]["pseudonyms"]))


def test_links_stay(spark):
    got = run(spark, [(i, t, "en") for i, t in FIND.items()])
    assert got[1]["pseudonyms"][0]["value"] == got[8]["pseudonyms"][0]["value"]
    digits = lambda x: re.sub(r"\D", "", x)
    cards = {digits(p["value"]) for i in (2, 8) for p in got[i]["pseudonyms"] if p["kind"] == "card"}
    assert len(cards) == 1
    dates = [p["value"] for p in got[5]["pseudonyms"]]
    y, m, d = dates[0].split("-")
    assert dates[1] == f"{d}/{m}/{y}" and dates[2] == f"{d}.{m}.{y}"
    other = run(spark, [(1, FIND[1], "en")], key="other")
    assert other[1]["text"] != got[1]["text"]


def test_permutations(spark):
    """All strings of a small length go to all strings of that length."""
    n = 1000
    digits = spark.range(n).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    assert digits.select(pii.permute(F.col("s"), "k", "t").alias("p")).distinct().count() == n
    letters = spark.range(26 * 26).select(
        F.concat(F.char(F.col("id") % 26 + 97), F.char(F.floor(F.col("id") / 26).cast("int") + 97)).alias("s")
    )
    out = letters.select(pii.permute(F.col("s"), "k", "t", letters=True).alias("p")).distinct()
    assert out.count() == 676 and out.filter(~F.col("p").rlike("^[a-z]{2}$")).count() == 0
    a, b = pii.DAY_FACTORS
    days = spark.range(0, a * b, 97).select("id", pii.network(F.floor(F.col("id") / b), F.col("id") % b, F.lit(a).cast("long"), F.lit(b).cast("long"), "k", "d").alias("x"))
    assert days.select((F.col("x.a") * b + F.col("x.b")).alias("y")).filter((F.col("y") >= 0) & (F.col("y") < a * b)).distinct().count() == days.count()


def test_clean_texts_stay(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(90, "12345 3.14 1.2.3 2024 a@b 10:30", "en")]
    got = run(spark, rows)
    for i, t, _ in rows:
        assert got[i]["text"] == t and got[i]["pseudonyms"] == []
    assert pii.pseudonymise(documents(spark, []), "k").count() == 0
    long = "the.72@mail3.example.com " * 3000
    assert len(run(spark, [(1, long, "en")])[1]["pseudonyms"]) == 3000


# ---- the whole operator the plain way


def network(a, b, n, m, kind, key="k"):
    draw = lambda turn, side, x: int(hashlib.sha256("|".join(map(str, (key, kind, side, turn, n, m, x))).encode()).hexdigest()[:15], 16)
    for turn in range(1, 6):
        a = (a + draw(turn, "a", b)) % n
        b = (b + draw(turn, "b", a)) % m
    return a, b


def permuted(symbols, kind, letters=False):
    radix, out = 26 if letters else 10, ""
    for i in range(0, len(symbols), 24):
        part = symbols[i : i + 24]
        u = len(part) // 2
        value = lambda s: sum((ord(c) - (97 if letters else 48)) * radix**p for p, c in enumerate(reversed(s)))
        pair = network(value(part[:u]), value(part[u:]), radix**u, radix ** (len(part) - u), f"{kind}{radix}")
        for x, width in zip(pair, (u, len(part) - u)):
            new = ""
            for _ in range(width):
                x, c = divmod(x, radix)
                new = chr(c + (97 if letters else 48)) + new
            out += new
    return out


def refill(shape, pattern, fill):
    fill = iter(fill)
    return "".join((lambda n: n.upper() if c.isupper() else n)(next(fill)) if re.fullmatch(pattern, c) else c for c in shape)


def digits(text):
    return re.sub("[^0-9]", "", text)


def mod97(plain):
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def new_date(m):
    forms = ("%d.%m.%Y",) if "." in m else ("%d/%m/%Y", "%m/%d/%Y") if "/" in m else ("%Y-%m-%d",)
    for form in forms:
        try:
            day = datetime.datetime.strptime(m, form).date()
        except ValueError:
            continue
        n = (day - datetime.date(1800, 1, 1)).days
        if 0 <= n < 627 * 233:
            a, b = network(n // 233, n % 233, 627, 233, "date")
            return (datetime.date(1800, 1, 1) + datetime.timedelta(a * 233 + b)).strftime(form)
    return None


def new_card(m):
    d = digits(m)
    if not luhn(d):
        return None
    body = permuted(d[:-1], "card")
    return refill(m, "[0-9]", next(body + c for c in "0123456789" if luhn(body + c)))


def new_value(kind, m):
    if not re.fullmatch({"email": pii.EMAIL, "iban": pii.IBAN, "date": pii.DATE, "ip": pii.IP, "ssn": pii.SSN, "phone": pii.PHONE, "card": pii.CARD}[kind], m):
        return None
    if kind == "email":
        name, _, rest = m.partition("@")
        letters = permuted(re.sub("[^a-z]", "", name.lower()), "email", True)
        return refill(refill(name, "[0-9]", permuted(digits(name), "email")), "[A-Za-z]", letters) + "@" + rest
    if kind == "iban":
        plain = m.replace(" ", "")
        if len(plain) < 15 or mod97(plain) != 1:
            return None
        body = refill(plain[4:], "[0-9]", permuted(digits(plain[4:]), "iban"))
        return refill(m, "[A-Z0-9]", plain[:2] + f"{98 - mod97(plain[:2] + '00' + body):02}" + body)
    if kind == "date":
        return new_date(m)
    if kind == "ip":
        p = [int(x) for x in m.split(".")]
        if max(p) > 255:
            return None
        return ".".join(str(y) for x in network(p[0] * 256 + p[1], p[2] * 256 + p[3], 1 << 16, 1 << 16, "ip") for y in divmod(x, 256))
    if kind == "ssn":
        return None if re.match("000|666|9", m) or "-00-" in m or m.endswith("-0000") else refill(m, "[0-9]", permuted(digits(m), "ssn"))
    if kind == "phone":
        land = re.match(r"\+[0-9]{1,3}(?=[ .\-(])", m)
        land = land[0] if land else ""
        d = digits(m[len(land) :])
        return land + refill(m[len(land) :], "[0-9]", permuted(d, "phone")) if 7 <= len(d) <= 15 else None
    return new_card(m)


def plain_pseudonyms(text, again=True):
    """(text, found): matches from the left; a valid card at the front of one that fails goes alone, and what is behind it is
    searched once more with the text up to the next match."""
    out, found, at, tail = "", [], 0, ""

    def gap(upto):
        nonlocal out
        if tail and again:
            inner, more = plain_pseudonyms(tail + text[at:upto], False)
            out += inner
            found.extend(more)
        else:
            out += tail + text[at:upto]

    for m in re.finditer(pii.PATTERN, text, re.ASCII):
        gap(m.start())
        at, tail, whole = m.end(), "", m[0]
        for kind in pii.KINDS:
            if (value := new_value(kind, whole)) is not None:
                found.append((kind, value))
                out += value
                break
        else:
            ends = [n for n in range(len(whole) - 1, 12, -1) if re.fullmatch("[0-9][ -]", whole[n - 1 : n + 1])]
            fronts = [whole[:n] for n in ends if re.fullmatch(pii.CARD, whole[:n]) and luhn(whole[:n])]
            if re.fullmatch(pii.CARD, whole) and len(whole) > 13 and fronts:
                out += new_card(fronts[0])
                found.append(("card", new_card(fronts[0])))
                tail = whole[len(fronts[0]) :]
            else:
                out += whole
    gap(len(text))
    return out, found


def test_against_plain_python(spark):
    rng = random.Random(6)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = number(15)
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice((whole, " ".join(whole[i : i + 4] for i in range(0, 16, 4)), "-".join(whole[i : i + 4] for i in range(0, 16, 4))))

    def iban():
        body = number(18)
        whole = f"DE{98 - mod97('DE00' + body):02}{body}"
        return rng.choice((whole, " ".join(whole[i : i + 4] for i in range(0, 22, 4))))

    makers = (
        card, iban, lambda: number(16), lambda: f"{rng.choice('abXy')}{number(2)}.{rng.choice(['Jo', 'ann'])}@mail{number(1)}.example.org",
        lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: f"+{number(2)} {number(3)} {number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}",
        lambda: ".".join(str(rng.randint(0, 299)) for _ in range(4)), lambda: f"{rng.randint(1700, 2300)}-{rng.randint(1, 13):02}-{rng.randint(1, 32):02}",
        lambda: f"{rng.randint(1, 31):02}/{rng.randint(1, 31):02}/{rng.randint(1800, 2100)}", lambda: f"{rng.randint(1, 31):02}.{rng.randint(1, 12):02}.{rng.randint(1800, 2100)}",
        lambda: "word", lambda: number(rng.randint(1, 5)), lambda: "BIC", lambda: "\n", lambda: "é中",
    )
    texts = [t for t in TEXTS if t] + list(FIND.values())
    texts += [rng.choice((" ", ", ", " x ")).join(rng.choice(makers)() for _ in range(rng.randint(1, 8))) for _ in range(120)]
    got = run(spark, [(i, t, "en") for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        text, found = plain_pseudonyms(t)
        assert got[i]["text"] == text, t
        assert [(p["kind"], p["value"]) for p in got[i]["pseudonyms"]] == found, t
