"""Vectors as whole numbers, and exact means of them, for the operators that fit centroids."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize

#: More than the relative error of any bound that is computed in floating point here.
SLACK = 2.0**-44


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), pa.array(values))


def whole_vectors(table: DataFrame, vector_col: str, scale: int, dims: int | None = None, **more: str) -> DataFrame:
    """A written table of each vector's floor(scale * component) as `x`, and of the columns that more names.

    Vectors that are null, hold null or non-finite components or have another length than dims, if given, are left out.
    A component that is too large for squared distances within 64 bits is an error.
    """
    chosen = table.filter(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("x"), *[F.col(c).alias(k) for k, c in more.items()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["x"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float)
            odd = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            ends = np.cumsum(lengths)
            keep = odd[ends] == odd[ends - lengths]
            if dims is not None:
                keep &= lengths == dims
            with np.errstate(over="ignore"):
                whole = np.floor(scale * values[np.repeat(keep, lengths)])
            if len(whole) and np.abs(whole).max() > min(isqrt((2**63 - 1) // (4 * int(lengths[keep].max()))), 2**31 - 1):
                raise ValueError(f"a vector has a component that is too large for distances of 64 bits, at scale {scale}")
            others = [batch[c].filter(pa.array(keep)) for c in more]
            yield pa.record_batch([*others, lists(whole.astype(np.int32), lengths[keep])], names=[*more, "x"])

    kept = ", ".join(f"{k} {chosen.schema[k].dataType.simpleString()}" for k in more)
    return materialize(chosen.mapInArrow(task, f"{kept}, x array<int>"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type = np.int64) -> np.ndarray:
    """A column of lists of one length, a row each."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


#: What a task gathers: how many vectors a slot has, and their sums by component.
SUMS = "slot int, n long, sums array<long>"


class Sums:
    """Counts and sums of a task's vectors by slot."""

    def __init__(self, slots: int, width: int):
        self.n, self.sums = np.zeros(slots, np.int64), np.zeros((slots, width), np.int64)

    def add(self, slots: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(slots, kind="stable")
        found, starts, n = np.unique(slots[order], return_index=True, return_counts=True)
        if len(found) and self.sums.shape[1]:
            self.sums[found] += np.add.reduceat(vectors[order], starts, axis=0)
        self.n[found] += n

    def rows(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.n)
        sums = self.sums[used]
        return pa.record_batch([pa.array(used, pa.int32()), pa.array(self.n[used]), lists(sums.ravel(), np.full(len(used), sums.shape[1]))], names=["slot", "n", "sums"])


def means(sums: DataFrame) -> dict[int, list[int]]:
    """floor(sum / count) of each slot that has vectors, exactly: a row a slot and component reaches the driver."""
    each = sums.select("slot", "n", F.posexplode("sums")).groupBy("slot", "pos")
    found: dict[int, list[int]] = {}
    for r in each.agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n")).orderBy("slot", "pos").collect():
        found.setdefault(r["slot"], []).append(int(r["sum"]) // r["n"])
    return found
