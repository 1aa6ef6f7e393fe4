"""Groups of sorted rows inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of rows that come sorted; what a batch cuts off waits for the next one. A yield may hold many
    groups: ``begins`` has where each begins."""

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if name == "sig":
                out[name] = np.frombuffer(b"".join(column.to_pylist()), U64).reshape(len(column), -1)
            elif pa.types.is_binary(column.type):
                out[name] = np.array([*column.to_pylist(), None], object)[:-1]
            else:
                out[name] = column.to_numpy(zero_copy_only=False)
        return out

    def split(rows: dict[str, np.ndarray], last: bool):
        n = len(rows[by[0]])
        new = np.zeros(n, bool)
        new[0] = True
        for name in by:
            new[1:] |= rows[name][1:] != rows[name][:-1]
        at = np.flatnonzero(new)
        stop = n if last else at[-1]
        return {k: v[:stop] for k, v in rows.items()} | {"begins": at if last else at[:-1]}, {
            k: v[stop:] for k, v in rows.items()
        }

    rest: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch)
        if rest and all(rows[k][-1] == rest[-1][k][-1] for k in by):
            rest.append(rows)
            continue
        rows = {k: np.concatenate([*(x[k] for x in rest), v]) for k, v in rows.items()}
        whole, left = split(rows, False)
        rest = [left]
        if len(whole["begins"]):
            yield whole
    if rest:
        yield split({k: np.concatenate([x[k] for x in rest]) for k in rest[0]}, True)[0]
