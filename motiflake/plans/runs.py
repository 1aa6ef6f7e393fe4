"""Whole runs from a graph file to results, as the command line of a graphlet tool offers them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import graphlets
from ..operators import aggregate as ag
from ..operators import enumerate as en
from ..operators import fast_sampling as fs
from ..operators import measures as ms
from ..operators import normalize as nm
from ..operators import sampling as sp
from ..sources import formats
from .stash import stash

SUFFIXES = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1 << 30}


def budget(text: str) -> int:
    """A number of samples, with a suffix for powers of 1,024."""
    last = text[-1:].lower()
    return int(float(text[:-1]) * SUFFIXES[last]) if last in SUFFIXES else int(text)


@dataclass
class Run:
    """What to do with a graph: k, the method (EXACT, NBE, EBE, PLAIN, AR, MCMC, RES), the output mode, and the options."""

    k: int = 4
    method: str = "EBE"
    mode: str = "frequency"
    samples: str = "10k"
    seed: int = 1
    raw: bool = False
    names: str = "ordinal"
    least_edges: int = 0
    ambiguity: int = 1
    orbits: tuple[int, int] = (11, 11)

    def sets(self, edges: DataFrame) -> DataFrame:
        n = budget(self.samples)
        if self.method == "EXACT":
            return en.connected_sets(edges, self.k)
        if self.method == "AR":
            return sp.accept_reject(edges, self.k, n, self.seed)
        if self.method == "RES":
            return sp.reservoir(edges, self.k, n, self.seed)
        if self.method == "MCMC":
            steps = 2 * self.k
            rows = stash(sp.walk(edges, self.k, max(1, n // steps), steps, self.seed).withColumn("sample", F.xxhash64("chain", "step")))
            told = en.induced_gint(rows.select("sample", "nodes"), edges, self.k, key="sample")
            return told.join(rows.select("sample", "multiplier"), "sample")
        return fs.grow(edges, self.k, n, self.method, self.seed)

    def apply(self, edges: DataFrame) -> DataFrame:
        """The result for edges (src, dst) of numbers."""
        sets, k = self.sets(edges), self.k
        if self.mode in ("frequency", "concentration") and self.method not in ("EXACT", "AR", "RES"):
            return sp.estimate(stash(sets), edges, k, self.method, self.raw)
        modes = {
            "frequency": lambda: ag.frequency(sets, k),
            "concentration": lambda: ag.concentration(sets, k),
            "odv": lambda: ag.orbit_table(sets, k),
            "gdv": lambda: ag.graphlet_table(sets, k),
            "index": lambda: ag.index_rows(sets, k, self.names, False, self.least_edges, self.ambiguity),
            "rooted": lambda: ag.index_rows(sets, k, self.names, True, self.least_edges, self.ambiguity),
            "orbits": lambda: ag.orbit_rows(sets, k),
            "communities": lambda: ag.communities(sets, k),
            "predict": lambda: ms.predict(sets, edges, k, *self.orbits),
        }
        return modes[self.mode]()

    def on_file(self, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        """The result for a graph file, and the dictionary (name, id) of its nodes."""
        raw = formats.read(spark, path)
        edges, names = nm.encode_names(raw.select("src", "dst"))
        return self.apply(stash(nm.clean(edges))), names


def sizes(k: int) -> tuple[int, int]:
    """How many canonical graphs and orbits of k nodes there are."""
    whole = graphlets.catalog(k)
    return len(whole.gints), max(x for o in whole.orbits for x in o) + 1
