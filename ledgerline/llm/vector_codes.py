"""Vector code compression: a vector as the numbers of codebook entries, a codebook for each part of it.

The entries of a part position stand in a ball tree. A search goes down it by branch and bound: of the distance to a
ball's middle and the radii between which its entries lie, the triangle inequality gives the least distance that any of
them can have, and the ball is visited unless that is more than the least distance found. Radii are rounded so that
the bounds never exceed the truth, balls at just the least distance are visited for their lower numbers, and each entry
that is met is compared in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize
from ledgerline.llm.integer_vectors import SLACK, SUMS, Sums, lists, matrix, means, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A ball of no more entries is searched through.
LEAF = 2


@dataclass
class Ball:
    """Entries whose distances from the middle of the ball above lie between low and high."""

    low: float
    high: float
    entries: list[int]  # of a leaf; else the middle alone
    split: int = -1  # squared distance from the middle up to which entries are in the first ball within
    within: list[Ball] = field(default_factory=list)


class BallTree:
    """One codebook: integer entries, of which the nearest to each of many parts is looked for."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.compared = entries, 0
        self.root = self._ball(list(range(len(entries))), np.zeros(len(entries), np.int64))

    def _ball(self, at: list[int], squares: np.ndarray) -> Ball:
        low, high = np.sqrt(squares.min()) * (1 - SLACK), np.sqrt(squares.max()) * (1 + SLACK)
        if len(at) <= LEAF:
            return Ball(low, high, at)
        middle, rest = at[0], at[1:]
        away = ((self.entries[rest] - self.entries[middle]) ** 2).sum(axis=1)
        split = int(np.sort(away)[(len(away) - 1) // 2])
        sides = [np.flatnonzero(away <= split), np.flatnonzero(away > split)]
        return Ball(low, high, [middle], split, [self._ball([rest[i] for i in side], away[side]) for side in sides if len(side)])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each part's nearest entry, the lowest of equally near ones, and the squared distance."""
        self.parts, self.place, self.least = parts, np.full(len(parts), len(self.entries), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(parts)))
        return self.place, self.least

    def _visit(self, ball: Ball, rows: np.ndarray) -> None:
        for entry in ball.entries:
            squares = ((self.parts[rows] - self.entries[entry]) ** 2).sum(axis=1)
            self.compared += len(rows)
            better = (squares < self.least[rows]) | ((squares == self.least[rows]) & (entry < self.place[rows]))
            self.place[rows[better]], self.least[rows[better]] = entry, squares[better]
        if not ball.within:
            return
        away, first = np.sqrt(squares), squares <= ball.split
        # Each row looks first into the ball that it would be in.
        for side, balls in ((first, ball.within), (~first, ball.within[::-1])):
            own, reach = rows[side], away[side]
            for inner in balls:
                bound = np.maximum(reach * (1 - SLACK) - inner.high, inner.low - reach * (1 + SLACK))
                near = bound <= np.sqrt(self.least[own]) * (1 + SLACK)
                if near.any():
                    self._visit(inner, own[near])


def _assign(batch: pa.RecordBatch, trees: list[BallTree], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of a batch's vectors (part position first), their entries and squared distances."""
    parts = matrix(batch["x"], width * len(trees)).reshape(batch.num_rows, len(trees), width).transpose(1, 0, 2)
    found = [tree.nearest(part) for tree, part in zip(trees, parts, strict=True)]
    return parts, np.array([f[0] for f in found]), np.array([f[1] for f in found])


def compress_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes of the vectors of finite components, each taken as floor(scale * component) and cut into equal parts.

    A part position's codebook starts as that part of the vectors of the smallest ids, ascending; a round assigns each
    part to its nearest entry, the lowest of equally near ones, and replaces each entry that has parts by the floor of
    their exact mean. Returns a row a vector (id, code: two hex digits a part, error: the squared distances summed, and
    the column that keep names) after a last assignment, and the codebooks by part, entry and component.

    Other vectors are left out. Rows that share an id are vectors of their own, started from in the order of their
    components; null ids are started from last. With fewer vectors than entries there are fewer entries. An empty table
    gives no rows and no codebooks. It is an error if lengths differ or cannot be cut into so many parts, or if a
    component is too large for distances of 64 bits.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    more = {"id": id_col} | ({"kept": keep} if keep else {})
    vectors = whole_vectors(table, vector_col, scale, **more)
    id_type, kept = vectors.schema["id"].dataType.simpleString(), f", kept {vectors.schema['kept'].dataType.simpleString()}" if keep else ""
    shortest, longest = vectors.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest is not None and (shortest != longest or longest % parts):
        raise ValueError(f"vectors of {shortest} to {longest} components cannot be cut into {parts} parts of one length")
    first = [r["x"] for r in vectors.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()]
    width = (longest or 0) // parts
    books = [[list(x[p * width : (p + 1) * width]) for x in first] for p in range(parts)] if first else []

    def trees(of: list[list[list[int]]]) -> list[BallTree]:
        return [BallTree(np.array(book, np.int64).reshape(len(book), width)) for book in of]

    for _ in range(rounds if first else 0):

        def gather(batches: Iterator[pa.RecordBatch], books: list = books) -> Iterator[pa.RecordBatch]:
            own, sums = trees(books), Sums(parts * len(books[0]), width)
            for batch in batches:
                cut, place, _ = _assign(batch, own, width)
                for p in range(parts):
                    sums.add(place[p] + p * len(books[0]), cut[p])
            yield sums.rows()

        moved = means(vectors.select("x").mapInArrow(gather, SUMS))
        if all(books[i // len(first)][i % len(first)] == x for i, x in moved.items()):
            break  # further rounds would change nothing
        books = [[moved.get(p * len(first) + e, x) for e, x in enumerate(book)] for p, book in enumerate(books)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees(books)
        for batch in batches:
            _, place, distance = _assign(batch, own, width)
            digits = place.T.astype(np.uint8).tobytes().hex()
            codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            out = {"id": batch["id"], "code": pa.array(codes, pa.string()), "error": pa.array(distance.sum(axis=0))}
            yield pa.record_batch(out | ({"kept": batch["kept"]} if keep else {}))

    schema = f"id {id_type}, code string, error long{kept}"
    coded = materialize(vectors.mapInArrow(encode, schema) if first else vectors.sparkSession.createDataFrame([], schema))
    return coded.withColumnsRenamed({"id": id_col} | ({"kept": keep} if keep else {})), books


def decode_vectors(coded: DataFrame, books: list[list[list[int]]], code_col: str = "code", scale: int = SCALE) -> DataFrame:
    """coded with `vector`, the entries that a code names, one after the other, over scale; null for a null code."""
    table = np.array(books, np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch["code"].to_pylist()
            found = [None if c is None else table[np.arange(len(table)), list(bytes.fromhex(c))].ravel() / scale for c in codes]
            yield pa.record_batch([batch["row"], pa.array(found, pa.list_(pa.float64()))], names=["row", "vector"])

    packed = coded.select(F.struct(*coded.columns).alias("row"), F.col(code_col).alias("code"))
    return packed.mapInArrow(task, f"row {packed.schema['row'].dataType.simpleString()}, vector array<double>").select("row.*", "vector")
