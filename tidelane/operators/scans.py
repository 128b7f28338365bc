"""Recurrences over array columns, backwards, for many rows at once.

A row's recurrence can't be split, but rows can be done together: step by step from the
end of each array, on Arrow's flat buffers, so that work grows with the elements and no
array is copied on the way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType


def scan_back(lists: list[pa.ListArray], step: Callable, states: int) -> pa.ListArray:
    """An array of doubles for each row. step(now, state) gets each list's element and the
    `states` running numbers (0 at the end) of all rows that are as long, and gives this
    place's value and the new running numbers. Null arrays give null; lists differ in length: an error."""
    length = np.nan_to_num(lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = [x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for x in lists]
    if any(len(x) != length.sum() for x in flat):
        raise ValueError("arrays of one row differ in length")
    ends, out = np.cumsum(length), np.zeros(int(length.sum()))
    order = np.argsort(-length, kind="stable")
    ends, last = ends[order] - 1, [np.zeros(len(order)) for _ in range(states)]
    longest = length[order]
    for k in range(int(longest[0]) if len(order) else 0):
        n = int(np.searchsorted(-longest, -k, side="left"))  # rows with more than k elements
        at = ends[:n] - k
        out[at], last = step([x[at] for x in flat], [x[:n] for x in last])
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out), mask=lists[0].is_null())


def backward(step: Callable, states: int, *lists: str | Column) -> Column:
    """scan_back as a column, over columns or SQL expressions of arrays."""
    of = [F.expr(x) if isinstance(x, str) else x for x in lists]
    return F.arrow_udf(lambda *arrays: scan_back(list(arrays), step, states), "array<double>", ArrowUDFType.SCALAR)(*of)
