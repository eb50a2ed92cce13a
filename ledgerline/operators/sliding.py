"""Aggregates over a ticker's last n values or rows, by numpy on batches of whole tickers.

Spark's sliding frames go through all n values again for every row, one at a time. Here Spark deals and sorts the rows by
ticker, and a task takes some tickers' columns as arrays. Every window is summed up of its own values, so nothing adds up over a ticker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Windows that are held at once.
CHUNK = 4096


def _median(view: np.ndarray, axis: int) -> np.ndarray:
    n = view.shape[axis]
    held = np.sort(view, axis=axis)
    return (held[:, (n - 1) // 2] + held[:, n // 2]) / 2


def _stddev(view: np.ndarray, axis: int) -> np.ndarray:
    """Of what each value differs from the first, so that equal values have a deviation of exactly 0."""
    return np.std(view - view[:, :1], axis=axis)


#: Rows that a task is dealt, about.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows, about, dealt by keys to the session's number of partitions, or to more if these would hold more than TASK_ROWS
    each: so what a task sorts does not grow with the table."""
    tasks = -(-n // TASK_ROWS)
    many = tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys) if many else rows.repartition(*keys)


#: What makes one of each n values that follow one another: by halves, or of all of them at once.
HALVES: dict[str, Callable] = {"avg": np.add, "sum": np.add, "max": np.maximum}
WHOLE: dict[str, Callable] = {"stddev": _stddev, "median": _median}
KINDS = (*HALVES, *WHOLE)


@dataclass(frozen=True)
class Sliding:
    """One aggregate of KINDS over n values. Dense: of the last n values that are not null, at rows that hold one, or with
    `at_null` at rows that hold none; else of the last n rows, null unless all of them hold a value."""

    kind: str
    value: Column
    n: int
    dense: bool = False
    at_null: bool = False


def _by_halves(values: np.ndarray, join: np.ufunc, n: int) -> np.ndarray:
    """Each n values joined, from runs of 1, 2, 4, ... values: a run is joined of two, a window of the runs whose lengths
    are n's powers of two. So a value is touched some log n times, and a window has no values but its own in it."""
    count = len(values) - n + 1
    out, runs, size, at = None, values, 1, 0
    while True:
        if n & size:
            part = runs[at : at + count]
            out, at = part if out is None else join(out, part), at + size
        if 2 * size > n:
            return out
        runs, size = join(runs[:-size], runs[size:]), 2 * size


def _windows(values: np.ndarray, kind: str, n: int) -> np.ndarray:
    """The aggregate of each n values that follow one another; one less than n fewer than there are values."""
    if len(values) < n:
        return np.empty(0)
    if kind in HALVES:
        out = _by_halves(values, HALVES[kind], n)
        return out / n if kind == "avg" else out
    view = np.lib.stride_tricks.sliding_window_view(values, n)
    return np.concatenate([WHOLE[kind](view[i : i + CHUNK], axis=1) for i in range(0, len(view), CHUNK)])


def _aggregate(values: np.ndarray, held: np.ndarray, row: np.ndarray, x: tuple) -> pa.Array:
    """Of several tickers' rows under one another; row is a row's number in its ticker, from 1."""
    kind, n, dense, at_null = x
    out, at = np.zeros(len(values)), np.arange(len(values))
    seen = np.concatenate(([0], np.cumsum(held)))
    if dense:
        found, total = _windows(values[held], kind, n), seen[1:]
        ok = (total - seen[at - row + 1] >= n) & (~held if at_null else held)
        out[ok] = found[total[ok] - n]
    else:
        found = _windows(values, kind, n)
        ok = (row >= n) & (seen[1:] - seen[np.maximum(at - n + 1, 0)] == n)
        out[ok] = found[at[ok] - n + 1]
    return pa.array(out, mask=~ok)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come by group, as tables of whole groups; `_row` is a row's number in its group, from 1."""
    held = []
    for batch in batches:
        opens = np.flatnonzero(batch["_row"].to_numpy() == 1)
        last = int(opens[-1]) if len(opens) else batch.num_rows
        held.append(batch.slice(0, last))
        if len(opens):
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield table
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def add_sliding(rows: DataFrame, new: dict[str, Sliding], keep: Iterable[str] | None = None) -> DataFrame:
    """Adds the aggregates, by ticker in the order of date. Rows that are dealt by ticker already are not shuffled again.

    `keep` names the rows' columns that stay, all by default: whatever stays goes through Python, used later or not.
    """
    kept = [c for c in rows.columns if keep is None or c in keep]
    if not new:
        return rows.select(*kept)
    named = {str(F.col(c)): c for c in kept if rows.schema[c].dataType == DoubleType()}
    values, specs = {}, {}
    for name, x in new.items():
        at = named.setdefault(str(x.value), f"_v{len(values)}")
        if at not in kept:
            values[at] = x.value.cast("double")
        specs[name] = (at, (x.kind, x.n, x.dense, x.at_null))
    # The window leaves a ticker's rows in one partition, under one another.
    numbered = rows.withColumns(values | {"_row": F.row_number().over(Window.partitionBy("ticker").orderBy("date"))}).select(*kept, *values, "_row")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            row = table["_row"].to_numpy()
            columns = {c: (table[c].to_numpy(), table[c].is_valid().to_numpy()) for c in {c for c, _ in specs.values()}}
            with np.errstate(all="ignore"):
                made = [_aggregate(*columns[c], row, x) for c, x in specs.values()]
            yield from pa.table([*(table[c] for c in kept), *made], names=[*kept, *specs]).combine_chunks().to_batches()

    return numbered.mapInArrow(task, StructType([*(rows.schema[c] for c in kept), *(StructField(c, DoubleType()) for c in new)]))
