"""Sampling over whole arrays: samples grow together, a node a step.

Draws are a hash of (seed, sample, step, try), so results do not depend on partitions. Where the adjacency lists are few enough they are
broadcast as three arrays; else each sample carries the lists of its nodes, a join a step, and takes the same draws: the
results are the same either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graphlets
from ..plans.stash import stash
from . import sampling
from .normalize import adjacency, numbered

#: Edges whose lists are gathered and broadcast at most; with more, joins carry the lists.
MOST_EDGES = 500_000
BATCH = 1 << 15
_U = np.uint64


def _draw(seed: int, sample: np.ndarray, step: int, attempt: int) -> np.ndarray:
    """A share of 1 for each sample, from a 64-bit mix of the arguments."""
    base = (seed * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03 + attempt * 0x8CB92BA72F3D8DD7) & 0xFFFFFFFFFFFFFFFF
    x = sample.astype(_U) * _U(0xBF58476D1CE4E5B9) + _U(base)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return ((x ^ (x >> _U(31))) >> _U(11)).astype(np.float64) / float(1 << 53)


class Lists:
    """Neighbours of node i (by order of id) from at[i] to at[i + 1], ascending, and all pairs as ascending keys."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, near: np.ndarray) -> None:
        self.ids, self.at, self.near = ids, at, near
        owner = np.repeat(np.arange(len(ids)), np.diff(at))
        self.keys = owner * len(ids) + near
        self.first = owner[owner < near]
        self.second = near[owner < near]

    def linked(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        key = u.astype(np.int64) * len(self.ids) + v
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[place] == key


def lists(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = edges.select("src", "dst").toArrow()  # 16 bytes an edge; rows one by one take far more
    return arrays(np.stack([table.column(c).to_numpy().astype(np.int64, copy=False) for c in ("src", "dst")], 1))


def arrays(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, at and near of :class:`Lists` for rows of two ends."""
    ids, flat = np.unique(rows, return_inverse=True)
    ends = flat.reshape(-1, 2)
    both = np.concatenate([ends, ends[:, ::-1]])
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return ids, np.concatenate([[0], np.cumsum(np.bincount(both[:, 0], minlength=len(ids)))]), both[:, 1].astype(np.int32)


def _outside(g: Lists, nodes: np.ndarray) -> np.ndarray:
    """How many different neighbours each row of nodes has outside itself."""
    n, p = nodes.shape
    size = (g.at[nodes + 1] - g.at[nodes]).ravel()
    place = np.repeat(g.at[nodes].ravel() - np.cumsum(size) + size, size) + np.arange(size.sum())
    row = np.repeat(np.repeat(np.arange(n), p), size)
    key = np.unique(row * len(g.ids) + g.near[place])
    own = np.concatenate([np.arange(n) * len(g.ids) + nodes[:, j] for j in range(p)])
    found = np.bincount(key // len(g.ids), minlength=n)
    at = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
    inner = (key[at] == own).reshape(p, n).sum(axis=0) if len(key) else 0
    return found - inner


class Grown(NamedTuple):
    numbers: np.ndarray  # of the samples that came this far
    nodes: np.ndarray  # places in a graph's ids, a row a sample
    gint: np.ndarray
    inside: np.ndarray  # edges among the nodes
    factor: np.ndarray


def _start(seed: int, numbers: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the edge that each sample starts from, and whether it is turned."""
    return (_draw(seed, numbers, 0, 0) * m).astype(np.int64), _draw(seed, numbers, 0, 1) < 0.5


def _step(g: Lists, now: Grown, p: int, k: int, method: str, seed: int) -> Grown:
    """One node more; samples without a neighbour left are dropped. g has the lists of the samples' nodes at least."""
    bit = graphlets.bit_of(k)
    numbers, nodes, gint, inside, factor = now
    deg = g.at[nodes + 1] - g.at[nodes]
    upto = np.cumsum(deg, axis=1)
    slots = upto[:, -1] - 2 * inside
    ok = slots > 0
    numbers, nodes, gint, inside, factor, upto, slots = (x[ok] for x in (numbers, nodes, gint, inside, factor, upto, slots))
    if method == "EBE":
        factor = factor * slots
    elif method == "NBE":
        factor = factor * _outside(g, nodes)
    new = np.full(len(numbers), -1, np.int64)
    links = np.zeros((len(numbers), p), bool)
    todo, attempt = np.arange(len(numbers)), 0
    while len(todo):
        hit = (_draw(seed, numbers[todo], p, 3 * attempt) * upto[todo, -1]).astype(np.int64)
        member = (upto[todo] <= hit[:, None]).sum(axis=1)
        low = np.where(member > 0, upto[todo, np.maximum(member - 1, 0)], 0)
        found = g.near[g.at[nodes[todo, member]] + hit - low].astype(np.int64)
        fine = (nodes[todo] != found[:, None]).all(axis=1)
        tried, found = todo[fine], found[fine]
        near = np.stack([g.linked(nodes[tried, q], found) for q in range(p)], 1)
        if method != "EBE":  # a node that several edges lead to is met as often: accept it as much less
            take = _draw(seed, numbers[tried], p, 3 * attempt + 1) * near.sum(axis=1) < 1
            tried, found, near = tried[take], found[take], near[take]
        new[tried], links[tried] = found, near
        todo = todo[new[todo] < 0]
        attempt += 1
    for q in range(p):
        gint = gint | (links[:, q].astype(np.int64) << bit[(p, q)])
    return Grown(numbers, np.concatenate([nodes, new[:, None]], 1), gint, inside + links.sum(axis=1), factor)


def _first(numbers: np.ndarray, nodes: np.ndarray, k: int) -> Grown:
    n = len(numbers)
    return Grown(numbers, nodes, np.full(n, 1 << graphlets.bit_of(k)[(1, 0)], np.int64), np.ones(n, np.int64), np.ones(n))


def sample(g: Lists, numbers: np.ndarray, k: int, method: str, seed: int) -> Grown:
    """The samples that reach k nodes."""
    start, flip = _start(seed, numbers, len(g.first))
    nodes = np.stack([g.first[start], g.second[start]], 1)
    nodes[flip] = nodes[flip][:, ::-1]
    now = _first(numbers, nodes, k)
    for p in range(2, k):
        now = _step(g, now, p, k, method, seed)
    return now


_CARRIED = "sample long, nodes array<bigint>, gint long, inside long, multiplier double"


def by_joins(edges: DataFrame, k: int, n: int, method: str, seed: int, m: int) -> DataFrame:
    """What :func:`grow` gives, for graphs of any size."""
    return _joined(*_tables(edges), k, n, method, seed, m)


def _tables(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists (w, nbrs) and the edges by number."""
    return adjacency(edges).select(F.col("id").alias("w"), "nbrs"), numbered(edges.select("src", "dst"), "src", "dst")


def _joined(lists: DataFrame, own: DataFrame, k: int, n: int, method: str, seed: int, m: int) -> DataFrame:
    spark = own.sparkSession

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, flip = _start(seed, batch.column("id").to_numpy(), m)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(no), pa.array(flip)], ["sample", "no", "flip"])

    ends = lambda u, v: F.array(F.col(u), F.col(v))
    at = spark.range(n).mapInArrow(begin, "sample long, no long, flip boolean").join(own, "no")
    rows = at.select("sample", F.when(F.col("flip"), ends("dst", "src")).otherwise(ends("src", "dst")).alias("nodes"))
    rows = rows.select(
        "sample", "nodes", F.lit(1 << graphlets.bit_of(k)[(1, 0)]).cast("long").alias("gint"), F.lit(1).cast("long").alias("inside"), F.lit(1.0).alias("multiplier")
    )
    rows = rows.withColumn("near", F.array().cast("array<array<bigint>>"))
    for p in range(2, k):
        # lists of the nodes that came in since the last step
        for q in range(2) if p == 2 else (p - 1,):
            rows = rows.join(lists, F.get("nodes", F.lit(q)) == F.col("w")).withColumn("near", F.concat("near", F.array("nbrs"))).drop("w", "nbrs")

        def step(batches: Iterator[pa.RecordBatch], p: int = p) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                nodes = batch.column("nodes").flatten().to_numpy()
                near = batch.column("near").flatten()
                size = near.value_lengths().to_numpy()
                others = near.flatten().to_numpy()
                # a graph of this batch: its nodes' lists, each once
                ids, place = np.unique(np.concatenate([nodes, others]), return_inverse=True)
                node, other = place[: len(nodes)], place[len(nodes) :]
                held, where = np.unique(node, return_index=True)
                begin = np.concatenate([[0], np.cumsum(size)])
                deg = np.zeros(len(ids), np.int64)
                deg[held] = size[where]
                spans = np.repeat(begin[where] - np.cumsum(size[where]) + size[where], size[where]) + np.arange(size[where].sum())
                g = Lists(ids, np.concatenate([[0], np.cumsum(deg)]), other[spans])
                own = lambda c: batch.column(c).to_numpy()
                now = Grown(own("sample"), node.reshape(-1, p), own("gint"), own("inside"), own("multiplier"))
                done = _step(g, now, p, k, method, seed)
                kept = pa.array(np.flatnonzero(np.isin(now.numbers, done.numbers)))
                columns = [pa.array(done.numbers), _listed(ids[done.nodes]), *(pa.array(x) for x in done[2:])]
                names = ["sample", "nodes", "gint", "inside", "multiplier"]
                if p < k - 1:
                    columns, names = [*columns, batch.column("near").take(kept)], [*names, "near"]
                yield pa.RecordBatch.from_arrays(columns, names)

        rows = rows.mapInArrow(step, _CARRIED + (", near array<array<bigint>>" if p < k - 1 else ""))
    return rows.select("sample", "nodes", "gint", "multiplier")


def _listed(nodes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, nodes.size + 1, nodes.shape[1], dtype=np.int32)), pa.array(nodes.ravel()))


def grow(edges: DataFrame, k: int, n: int, method: str = "EBE", seed: int = 1) -> DataFrame:
    """(sample, nodes, gint, multiplier) of n samples, as :func:`.sampling.grow` describes them, with draws of this module."""
    return sampler(edges, k, method)(n, seed)


def sampler(edges: DataFrame, k: int, method: str, often: bool = False) -> Callable[[int, int], DataFrame]:
    """:func:`grow` by n and seed. The graph is gathered, or numbered, once for all draws; if they are many (``often``) its tables are
    written too."""
    if method not in sampling.METHODS:
        raise ValueError(f"{method} is none of {sampling.METHODS}")
    if often:
        edges = stash(edges.select("src", "dst"))
    m = edges.count()
    spark = edges.sparkSession
    if m > MOST_EDGES:
        near, own = _tables(edges)
        if often:
            near = stash(near)
        return lambda n, seed: _joined(near, own, k, n, method, seed, m)
    shared = spark.sparkContext.broadcast(lists(edges))

    def drawn(n: int, seed: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = Lists(*shared.value)
            for batch in batches:
                all_of = batch.column("id").to_numpy()
                for a in range(0, len(all_of), BATCH):
                    done = sample(g, all_of[a : a + BATCH], k, method, seed)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(done.numbers), _listed(g.ids[done.nodes]), pa.array(done.gint), pa.array(done.factor)],
                        ["sample", "nodes", "gint", "multiplier"],
                    )

        return spark.range(n if m else 0).mapInArrow(run, "sample long, nodes array<bigint>, gint long, multiplier double")

    return drawn
