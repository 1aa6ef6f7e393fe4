"""Random draws that depend on their arguments alone: the same on every engine, partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are whole numbers below this.
SPAN = 1 << 32


def draw(*parts) -> Column:
    """A number from 0 to SPAN - 1, from the first 32 bits of the MD5 of the parts joined by bars."""
    told = F.concat_ws("|", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("long")


def below(limit: Column, *parts) -> Column:
    """A number from 0 to limit - 1; 0 where limit is less than 1, as a plan may try rows that a filter is to drop."""
    return draw(*parts) % F.greatest(limit, F.lit(1))
