"""Streams of edges and samples: counts that grow, duplicates dropped within a watermark, sampling until precise.

The engine's batch operators need no stream; these are their forms for input that does not end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import aggregate as ag
from ..plans import catalogs


def degree_counts(arcs: DataFrame) -> DataFrame:
    """(id, deg): running degrees of a stream of edges (src, dst)."""
    return arcs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))


def windowed_degrees(arcs: DataFrame, width: str, late: str) -> DataFrame:
    """(window, id, deg) of edges (ts, src, dst), final once the watermark passes the window."""
    ends = arcs.withWatermark("ts", late).select("ts", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy(F.window("ts", width), "id").agg(F.count("*").alias("deg"))


def recent_once(samples: DataFrame, late: str) -> DataFrame:
    """samples (ts, nodes, ...), each set of nodes once within the watermark."""
    keyed = samples.withColumn("key", F.array_join(F.array_sort("nodes"), ",")).withWatermark("ts", late)
    return keyed.dropDuplicatesWithinWatermark(["key"])


def orbit_counts(samples: DataFrame, k: int) -> DataFrame:
    """(node, orbit, count): running orbit degrees of a stream of samples (nodes, gint)."""
    spark = samples.sparkSession
    place = catalogs.orbits(spark, k).select("ordinal", "pos", "orbit")
    told = samples.join(F.broadcast(catalogs.canon_map(spark, k)), "gint")
    at = told.select("ordinal", "nodes", F.posexplode("perm").alias("pos", "at")).select("ordinal", "pos", F.expr("nodes[at]").alias("node"))
    return at.join(F.broadcast(place), ["ordinal", "pos"]).groupBy("node", "orbit").agg(F.count("*").alias("count"))


def walk_windows(steps: DataFrame, length: int) -> DataFrame:
    """(chain, step, nodes) of a stream of walk steps (chain, step, u, v): the different nodes of each chain's last ``length`` edges. A
    chain's state is those edges alone. Steps of a batch are taken in their order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, vs = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for row in rows.itertuples():
            us, vs = [*us, int(row.u)][-length:], [*vs, int(row.v)][-length:]
            if len(us) == length:
                out.append((key[0], row.step, sorted({*us, *vs})))
        state.update((us, vs))
        yield pd.DataFrame(out, columns=["chain", "step", "nodes"])

    return steps.groupBy("chain").applyInPandasWithState(
        run, "chain long, step long, nodes array<bigint>", "us array<bigint>, vs array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def count_batches(samples: DataFrame, k: int, keep: Callable[[DataFrame, int], None]):
    """A writer that hands the counts of each micro-batch of samples (nodes, gint) to keep(counts, batch)."""

    def each(batch: DataFrame, number: int) -> None:
        keep(ag.counts(batch, k).withColumn("batch", F.lit(number)), number)

    return samples.writeStream.foreachBatch(each)
