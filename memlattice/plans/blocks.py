"""Runs of whole groups inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of whole groups, each of at most about ``most`` rows; rows come sorted by the text column ``key``."""
    held: list[pa.Table] = []
    size, group = 0, None
    for batch in batches:
        names = batch.column(key).dictionary_encode()
        codes = names.indices.to_numpy()
        starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            now = names[a].as_py()
            if held and now != group and size >= most:
                yield pa.concat_tables(held)
                held, size = [], 0
            group = now
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
            size += b - a
    if held:
        yield pa.concat_tables(held)
