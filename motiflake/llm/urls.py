"""URL filters over a sorted digest array.

Rules and blocked hosts become 64-bit xxhash keys in one sorted array, next to the full strings, in a file that Spark ships
once to each executor and that tasks map into memory. Urls are cut by array functions, and those of one host and path prefix are
looked up once a batch: their candidate keys (each parent domain with each prefix of the path that has the length of some
rule's) are probed together by binary search, and a hit counts only if the stored string is the candidate's. The file is bounded by ``MAX_BYTES``; larger lists are a table, and :func:`judge_joined` joins it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules of the base.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
# What spam hosts are named by.
TRADES = "casino poker slots bets lottery pills meds loans credit crypto replica watches dating escort torrent warez".split()
LURES = "win online free cheap best now club deals bonus express vip pro direct instant fast live".split()
ENDINGS = ("com", "net", "org", "info", "biz", "top", "xyz", "example.com", "example.net", "example.org")


def spam_hosts(trades: Iterable[str] = TRADES, lures: Iterable[str] = LURES, endings: Iterable[str] = ENDINGS) -> list[str]:
    """Hosts of a trade and a lure, in either order, under each ending."""
    return [f"{name}.{end}" for t in trades for w in lures for name in (f"{t}-{w}", f"{w}-{t}") for end in endings]


#: Hosts blocked with their subdomains where no rule decides: made by rule, to be replaced by a maintained list.
BLOCKED_HOSTS = tuple(spam_hosts())
MAX_BYTES = 256 << 20
_KINDS = ("allow", "block", "host")


class Digest(NamedTuple):
    """Sorted keys, where each key's string begins in ``strings``, its kind, and the lengths that rules' paths have."""

    keys: np.ndarray
    at: np.ndarray
    kinds: np.ndarray
    strings: np.ndarray
    lengths: tuple[int, ...]

    def find(self, candidates: list[str]) -> np.ndarray:
        """For each candidate the place of its string here, or -1."""
        raw = [c.encode() for c in candidates]
        want = np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), np.uint64, len(raw))
        place = np.searchsorted(self.keys, want)
        out = np.full(len(raw), -1)
        hit = np.flatnonzero(place < len(self.keys))
        hit = hit[self.keys[place[hit]] == want[hit]]
        for i in hit.tolist():
            j = int(place[i])
            while j < len(self.keys) and self.keys[j] == want[i]:  # several strings may share a key
                if self.strings[self.at[j] : self.at[j + 1]].tobytes() == raw[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def string(self, place: int) -> str:
        return self.strings[self.at[place] : self.at[place + 1]].tobytes().decode()


def write(rules: Iterable[tuple[str, str]], hosts: Iterable[str], path: str) -> int:
    """Writes a digest file and returns its size. Of rules with the same string the last one counts."""
    entries = {rule: _KINDS.index(verdict) for verdict, rule in rules}
    # a blocked host is kept apart from a rule of the same string by a mark that no host holds
    entries |= {f"#{host.lower()}": 2 for host in hosts}
    raw = [(xxhash.xxh64_intdigest(s.encode()), s.encode(), k) for s, k in entries.items()]
    raw.sort(key=lambda x: x[:2])
    lengths = sorted({len(s) - s.find("/") if "/" in s else 0 for s, k in entries.items() if k < 2})
    with open(path, "wb") as f:
        np.array([len(raw), len(lengths), *lengths], np.int64).tofile(f)
        np.array([k for k, _, _ in raw], np.uint64).tofile(f)
        np.cumsum([0, *(len(s) for _, s, _ in raw)], dtype=np.int64).tofile(f)
        np.array([k for _, _, k in raw], np.int64).tofile(f)
        f.write(b"".join(s for _, s, _ in raw))
    return os.path.getsize(path)


def read(path: str) -> Digest:
    """A digest file, mapped into memory: pages are read as they are probed."""
    whole = np.memmap(path, np.uint8, "r")
    n, m = (int(x) for x in whole[:16].view(np.int64))
    lengths = tuple(whole[16 : 16 + 8 * m].view(np.int64).tolist())
    at = 16 + 8 * m
    keys = whole[at : at + 8 * n].view(np.uint64)
    begins = whole[at + 8 * n : at + 8 * (2 * n + 1)].view(np.int64)
    kinds = whole[at + 8 * (2 * n + 1) : at + 8 * (3 * n + 1)].view(np.int64)
    return Digest(keys, begins, kinds, whole[at + 8 * (3 * n + 1) :], lengths)


@lru_cache(maxsize=4)
def _shipped(name: str) -> Digest:
    return read(SparkFiles.get(name))


def ship(spark: SparkSession, rules: Iterable[tuple[str, str]], hosts: Iterable[str]) -> str:
    """Writes a digest on the driver, hands it to Spark for the executors, and returns the name it has there."""
    folder = tempfile.mkdtemp(prefix="digest-")
    plain = os.path.join(folder, "digest")
    if (size := write(rules, hosts, plain)) > MAX_BYTES:
        os.remove(plain)
        raise ValueError(f"{size} bytes of rules are over {MAX_BYTES}: put them in a table and use judge_joined")
    with open(plain, "rb") as f:
        name = f"digest-{xxhash.xxh128_hexdigest(f.read())}"
    if any(p.rpartition("/")[2] == name for p in spark.sparkContext.listFiles):
        os.remove(plain)
        return name
    os.rename(plain, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def split(urls: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Hosts and paths as the base defines them."""
    cut = pc.extract_regex(urls.cast(pa.string()), r"(?s)^.*?://(?P<host>[^/?#]*)(?P<path>[^?#]*)")
    part = lambda name: pc.fill_null(pc.struct_field(cut, name), "")
    return pc.ascii_lower(part("host")), part("path")


def parents(host: str) -> list[str]:
    """The host and its parent domains, from the host up."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]] = RULES,
    hosts: Iterable[str] = BLOCKED_HOSTS,
    id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """A row per page: id, host, path, rule, verdict.

    A rule (verdict, ``host/path``) fits its host and all subdomains where the url's path starts with the rule's. Of those that
    fit, the longest string decides; of equally long ones, the one with the longer host. Without one, rule is null, and a
    url is blocked if its host or a parent domain is among hosts, else allowed. A url that is null or has no ``://`` has an
    empty host and path, and is allowed. Rows are judged one by one, without a shuffle; other columns are not read; ids that
    are no whole numbers raise.
    """
    spark = pages.sparkSession
    name = ship(spark, list(rules), list(hosts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _shipped(name)
        longest = max(digest.lengths, default=0)
        for batch in batches:
            host, path = split(batch.column(url))
            # a host has no slash and a path begins with one, so the two can be told apart in one string
            cases = pc.binary_join_element_wise(host, pc.utf8_slice_codeunits(path, 0, longest), "").dictionary_encode()
            candidates: list[str] = []
            owner: list[int] = []
            for i, case in enumerate(cases.dictionary.to_pylist()):
                own, slash, rest = case.partition("/")
                for parent in parents(own):
                    tried = [parent + (slash + rest)[:n] for n in digest.lengths if n <= len(slash + rest)]
                    candidates += [*tried, f"#{parent}"]
                    owner += [i] * (len(tried) + 1)
            found = digest.find(candidates)
            rule: list[str | None] = [None] * len(cases.dictionary)
            verdict = ["allow"] * len(cases.dictionary)
            for c in np.flatnonzero(found >= 0).tolist():
                i, text, kind = owner[c], candidates[c], int(digest.kinds[found[c]])
                if kind == 2:
                    if rule[i] is None:
                        verdict[i] = "block"
                # a parent's candidates come after its children's, so of equal lengths the longer host stays
                elif rule[i] is None or len(text) > len(rule[i]):
                    rule[i], verdict[i] = text, _KINDS[kind]
            columns = [pa.array(x, pa.string()).take(cases.indices) for x in (rule, verdict)]
            yield pa.RecordBatch.from_arrays([batch.column(id).cast(pa.int64()), host, path, *columns], ["id", "host", "path", "rule", "verdict"])

    out = pages.select(id, url).mapInArrow(run, "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id)


def judge_joined(
    pages: DataFrame,
    rules: DataFrame,
    hosts: DataFrame,
    lengths: list[int] | None = None,
    id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """As :func:`judge`, for lists of any size: rules is a table (verdict, rule), hosts one of blocked hosts (host), lengths the
    lengths that the rules' paths have (found out if not given; they are few). Each different pair of a host and a path
    prefix is looked up once, so a common host is no hot key of the joins with the lists. One row per row."""
    if lengths is None:
        slash = F.instr("rule", "/")
        told = rules.select(F.when(slash > 0, F.char_length("rule") - slash + 1).otherwise(0).alias("n")).distinct()
        lengths = sorted(r["n"] for r in told.collect())
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.col(id).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("prefix", F.substring("path", 1, max(lengths, default=0)))
    cases = rows.select("host", "prefix").filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("prefix"))
    tried = F.flatten(F.transform(fitting, lambda n: F.transform(above, lambda h: F.concat(h, F.substring("prefix", F.lit(1), n)))))
    size = F.struct(F.char_length("rule"), F.char_length(F.substring_index("rule", "/", 1)))
    met = cases.select("host", "prefix", F.explode(tried).alias("rule")).join(rules.select("verdict", "rule"), "rule")
    best = met.groupBy("host", "prefix").agg(F.max_by(F.struct("rule", "verdict"), size).alias("best"))
    parent = cases.select("host").distinct().select("host", F.explode(above).alias("parent"))
    blocked = parent.join(hosts.select(F.lower("host").alias("parent")).distinct(), "parent", "left_semi").select("host").distinct()
    told = cases.join(best, ["host", "prefix"], "left").join(blocked.withColumn("bad", F.lit(True)), "host", "left")
    told = told.select(
        "host", "prefix", "best.rule", F.coalesce("best.verdict", F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict")
    )
    return rows.join(told, ["host", "prefix"], "left").select(
        F.col("id").alias(id), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )
