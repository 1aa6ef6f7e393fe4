"""Small helpers over Spark columns that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of the whitespace kind: everything but space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body names it. The one-element array keeps
    Catalyst from copying the expression into each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two arrays of shares."""

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (half(a, b) + half(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
