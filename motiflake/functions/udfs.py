"""Functions for SQL: the canonical form of a graph number, and a table function that samples graphlets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graphlets


@lru_cache(maxsize=1 << 16)
def _form(gint: int, k: int) -> tuple[int, list[int]]:
    low, perm = graphlets.canonicalize(gint, k)
    return int(low), [int(p) for p in perm]


def _canonicalize(gint: pd.Series, k: pd.Series) -> pd.DataFrame:
    known = gint.notna() & k.notna()
    forms = [_form(int(g), int(n)) if ok else (None, None) for g, n, ok in zip(gint, k, known)]
    return pd.DataFrame(forms, columns=["canonical", "perm"], dtype=object)


class SampleGraphlets:
    """``sample_graphlets(TABLE(edges) WITH SINGLE PARTITION, k, n, method)``: rows (sample, nodes, gint, multiplier), as
    :func:`motiflake.operators.fast_sampling.grow` draws them with seed 1. The edges (src, dst, src < dst, each once) come to
    one task, which refuses more than that module broadcasts."""

    def __init__(self) -> None:
        self.edges: list[tuple[int, int]] = []
        self.given = (0, 0, "")

    def eval(self, row, k: int, n: int, method: str) -> None:
        from ..operators.fast_sampling import MOST_EDGES

        self.edges.append((row["src"], row["dst"]))
        self.given = (k, n, method)
        if len(self.edges) > MOST_EDGES:
            raise ValueError(f"over {MOST_EDGES} edges: use motiflake.operators.fast_sampling.grow")

    def terminate(self) -> Iterator[tuple]:
        from ..operators import fast_sampling as fs

        if self.edges:
            k, n, method = self.given
            g = fs.Lists(*fs.arrays(np.array(self.edges, np.int64)))
            for a in range(0, n, fs.BATCH):
                done = fs.sample(g, np.arange(a, min(n, a + fs.BATCH)), k, method, 1)
                for s, nodes, gint, factor in zip(done.numbers.tolist(), g.ids[done.nodes].tolist(), done.gint.tolist(), done.factor.tolist()):
                    yield s, nodes, gint, factor


def register(spark: SparkSession) -> None:
    """Makes ``canonicalize(gint, k)`` (struct of canonical number and perm, null for nulls) and ``sample_graphlets`` known to SQL."""
    form = T.StructType([T.StructField("canonical", T.LongType()), T.StructField("perm", T.ArrayType(T.IntegerType()))])
    spark.udf.register("canonicalize", F.pandas_udf(_canonicalize, form))
    spark.udtf.register("sample_graphlets", F.udtf(SampleGraphlets, returnType="sample: bigint, nodes: array<bigint>, gint: bigint, multiplier: double"))
