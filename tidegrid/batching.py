"""Arrow batches cut at group borders, for operators that work on many groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Number of the run of equal keys each row belongs to (rows are sorted by the keys)."""
    change = np.zeros(table.num_rows, bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            column = column.dictionary_encode().indices
        values = np.asarray(column)
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 65536) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by keys, each of at least `rows` rows (but
    the last), with the run number of every row. A group is held whole, so callers bound its size."""
    held: list[pa.RecordBatch] = []
    size, want = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < want:
            continue
        merged = pa.Table.from_batches(held)
        run = codes(merged, keys)
        cut = int(np.searchsorted(run, run[-1]))
        if cut:
            yield merged.slice(0, cut), run[:cut]
        rest = merged.slice(cut)
        held, size = rest.to_batches(), rest.num_rows
        want = max(rows, 2 * size)
    if size:
        merged = pa.Table.from_batches(held)
        yield merged, codes(merged, keys)


def column(table: pa.Table, name: str, dtype: str = "float64") -> np.ndarray:
    """A column as numpy; NULL becomes NaN in floats."""
    values = table.column(name)
    if dtype == "float64":
        return values.to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def group_quantile(values: np.ndarray, group: np.ndarray, groups: int, share: float = 0.5) -> np.ndarray:
    """Nearest-rank quantile per group; NaN for a group without values."""
    n = np.bincount(group, minlength=groups)
    out = np.full(groups, np.nan)
    if len(values):
        ordered = values[np.lexsort((values, group))]
        start = np.cumsum(n) - n
        has = n > 0
        out[has] = ordered[(start + np.floor((n - 1) * share).astype(int))[has]]
    return out
