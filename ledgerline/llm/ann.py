"""Approximate nearest neighbours by stable projections and kd-trees with a chi-square stopping test.

Vectors are projected to a few dimensions with a Gaussian (2-stable) matrix, so that the squared distance of two
projections, over the squared distance of the vectors, follows a chi-square law. A query meets vectors in order of
their projected distance and verifies them by their true distance, until the next projected distance is so long that a
vector nearer than the k-th one so far would be seen by now with the wanted probability. How much that spares depends
on the data: little if a query's neighbours are hardly nearer than the rest, as among random directions.

At scale the projected space is cut into cells by a top kd-tree whose cuts are fitted on a bounded sample; every vector
is indexed in its cell, and a large cell is dealt to several tasks, each with its own kd-tree. A query searches its own
cell first, and the distance that it finds there settles, by the same test, which other cells it visits.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize

DIMS, K, SEED = 12, 10, 7
#: The probability of the stopping test. A true neighbour is missed if its projection is longer than this part of the law.
SURE = 0.85
#: Vectors that the cuts of the top tree are fitted on, at most; vectors of a task's kd-tree; cells, at most.
SAMPLE, TREE, CELLS = 20_000, 16_384, 4096
#: Vectors of a leaf, leaves opened at a time, and vectors verified between two tests.
LEAF, LEAVES, STRIDE = 64, 8, 64


def chi_square_cdf(x: float, dims: int) -> float:
    """The chance that a chi-square variable of an even number of degrees of freedom is at most x."""
    if dims % 2:
        raise ValueError("an even number of projections is needed")
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_ratio(sure: float, dims: int) -> float:
    """The squared projected distance, in units of the squared k-th distance, from which a search may stop."""
    low, high = 0.0, 1.0
    while chi_square_cdf(high, dims) < sure:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dims) < sure else (low, mid)
    return high


def projection(size: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dims))


class KdTree:
    """A kd-tree over a task's projected vectors, cut at medians of the widest side; leaves hold up to LEAF vectors."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.nodes = points, []
        self._grow(np.arange(len(points)), leaf)

    def _grow(self, own: np.ndarray, leaf: int) -> int:
        low, high = self.points[own].min(axis=0), self.points[own].max(axis=0)
        at = len(self.nodes)
        self.nodes.append((low, high, own, None))
        side = int(np.argmax(high - low))
        if len(own) > leaf and high[side] > low[side]:
            order = own[np.argsort(self.points[own, side], kind="stable")]
            half = len(order) // 2
            self.nodes[at] = (low, high, None, (self._grow(order[:half], leaf), self._grow(order[half:], leaf)))
        return at

    def nearby(self, query: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Groups of vectors by a lower bound of their squared projected distance, nearest first: a leaf at a time."""
        heap = [(self._bound(0, query), 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            _, _, own, children = self.nodes[at]
            if children is None:
                yield bound, own
            else:
                for child in children:
                    heapq.heappush(heap, (self._bound(child, query), child))

    def _bound(self, at: int, query: np.ndarray) -> float:
        low, high = self.nodes[at][:2]
        off = np.maximum(np.maximum(low - query, query - high), 0)
        return float(off @ off)


def search(tree: KdTree, vectors: np.ndarray, vector: np.ndarray, query: np.ndarray, free: np.ndarray, k: int, ratio: float, within: float = math.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """The k nearest found: squared distances and places, and how many vectors were verified.

    Vectors are verified by their true distance in the order of their projected one, STRIDE at a time, until the next
    projected distance passes the test against the k-th one so far; within is a squared distance already known for it.
    free says which places may be answers.
    """
    best_d, best_i, kth, verified = np.empty(0), np.empty(0, np.int64), within, 0
    wait_d, wait_i = np.empty(0), np.empty(0, np.int64)
    leaves, bound = tree.nearby(query), 0.0

    def settle(most: float) -> None:
        """Verify what waits up to a projected distance."""
        nonlocal best_d, best_i, kth, verified, wait_d, wait_i
        ready = np.flatnonzero(wait_d <= min(most, ratio * kth))
        ready = ready[np.argsort(wait_d[ready], kind="stable")]
        for i in range(0, len(ready), STRIDE):
            if wait_d[ready[i]] > ratio * kth:
                break
            places = wait_i[ready[i : i + STRIDE]]
            off = vectors[places] - vector
            verified += len(places)
            best_d, best_i = np.concatenate((best_d, np.einsum("ij,ij->i", off, off))), np.concatenate((best_i, places))
            if len(best_d) >= k:
                order = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[order], best_i[order]
                kth = min(kth, float(best_d[-1]))
        keep = (wait_d > most) & (wait_d <= ratio * kth)
        wait_d, wait_i = wait_d[keep], wait_i[keep]

    while bound <= ratio * kth:
        taken = []
        for bound, places in leaves:
            taken.append(places)
            if len(taken) == LEAVES:
                break
        if not taken:
            break
        new = np.concatenate(taken)
        new = new[free[new]]
        off = tree.points[new] - query
        wait_d, wait_i = np.concatenate((wait_d, np.einsum("ij,ij->i", off, off))), np.concatenate((wait_i, new))
        settle(bound)
    settle(math.inf)
    return best_d, best_i, verified


class Cells:
    """The top kd-tree: cuts of the projected space, fitted on a sample; at most CELLS leaves, so it may be broadcast."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cuts: list[tuple[int, float] | None] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self._fit(sample, cells, np.full(sample.shape[1], -np.inf), np.full(sample.shape[1], np.inf))
        self.low, self.high = (np.array(x) for x in zip(*self.boxes, strict=True))

    def _fit(self, sample: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> None:
        """Nodes in depth-first order: (side, cut, right child) inside, the cell's number in a leaf."""
        at = len(self.cuts)
        self.cuts.append(None)
        width = sample.max(axis=0) - sample.min(axis=0) if len(sample) else np.zeros(len(low))
        side = int(np.argmax(width)) if len(width) else 0
        if cells <= 1 or len(sample) < 2 or width[side] <= 0:
            self.cuts[at] = (-1, len(self.boxes), 0)
            self.boxes.append((low, high))
            return
        cut = float(np.median(sample[:, side]))
        left = sample[:, side] < cut
        if not left.any():
            left = sample[:, side] <= cut
            cut = float(np.nextafter(cut, np.inf))
        below, above = high.copy(), low.copy()
        below[side] = above[side] = cut
        self._fit(sample[left], cells // 2, low, below)
        self.cuts[at] = (side, cut, len(self.cuts))
        self._fit(sample[~left], cells - cells // 2, above, high)

    def of(self, point: np.ndarray) -> int:
        at = 0
        while self.cuts[at][0] >= 0:
            side, cut, right = self.cuts[at]
            at = at + 1 if point[side] < cut else right
        return self.cuts[at][1]

    def near(self, point: np.ndarray, limit: float) -> np.ndarray:
        """The cells within a squared projected distance."""
        off = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero(np.einsum("ij,ij->i", off, off) <= limit)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def nearest_neighbours(
    table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dims: int = DIMS, sure: float = SURE, tree: int = TREE, seed: int = SEED, with_work: bool = False
) -> DataFrame:
    """For each row that is_query holds for, its k nearest of all other rows: query_id, rank, vec_id, score (distance).

    Distances are Euclidean, in double precision on the original vectors; ties go to the smaller id. Null, empty or
    zero vectors, those with null or non-finite components, those of another length than most, and null ids take no
    part. A row never is its own neighbour; rows that share its id are rows like any other, and each asks for itself.
    An empty table gives no rows. The cuts are fitted on at most SAMPLE vectors; all vectors are indexed. with_work
    adds `verified`, how many vectors the query was compared with.
    """
    rows = table.filter(_usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size, count = (sizes[0], sizes[1]) if sizes else (1, 0)
    rows = rows.filter(F.size("vector") == size)
    matrix, ratio = projection(size, dims, seed), stop_ratio(sure, dims)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // SAMPLE)))) == 0).select("vector").limit(SAMPLE).toArrow()
    points = _matrix(sample["vector"], size) @ matrix if sample.num_rows else np.zeros((0, dims))
    cells = Cells(points, max(1, min(CELLS, -(-count // tree))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                projected = _matrix(batch["vector"], size) @ matrix
                yield pa.record_batch([*batch.columns, pa.array([cells.of(p) for p in projected], pa.int32())], names=["row", "id", "vector", "asks", "cell"])

    # A query is one row whose vector is all it needs; its projection is computed again where it is used.
    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector", "asks")
    placed = materialize(keyed.mapInArrow(place, "row long, id long, vector array<double>, asks boolean, cell int"))
    deals = materialize(placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / tree)).cast("int").alias("deals")))
    dealt = placed.join(F.broadcast(deals), "cell").select("cell", F.pmod(F.xxhash64("row"), F.col("deals")).cast("int").alias("deal"), F.lit(0).alias("asked"), "row", "id", "vector", F.lit(None).cast("double").alias("within"))
    asking = placed.filter("asks")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell and deal, the indexed vectors before the queries."""
        where, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, out = _matrix(batch["vector"], size), []
            for i, (cell, deal, asked, row, own, within) in enumerate(zip(*(batch[c].to_pylist() for c in ("cell", "deal", "asked", "row", "id", "within")), strict=True)):
                if where != (cell, deal):
                    where, held, index = (cell, deal), [], None
                if not asked:
                    held.append((own, row, vectors[i]))
                    continue
                if not held:
                    continue
                if index is None:
                    held.sort(key=lambda x: x[:2])  # of equal distances the smaller id comes first
                    ids, keys, data = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held])
                    index = KdTree(data @ matrix)
                distances, places, verified = search(index, data, vectors[i], vectors[i] @ matrix, keys != row, k, ratio, math.inf if within is None else within)
                out.append((row, own, distances, ids[places], verified))
            if out:
                lengths = [len(x[2]) for x in out]
                each = np.repeat(np.arange(len(out)), lengths)
                numbers = {k: np.array([x[i] for x in out], np.int64) for k, i in (("row", 0), ("query_id", 1), ("verified", 4))}
                # A query's work stands on the first of its rows here.
                first = np.concatenate(([True], each[1:] != each[:-1])) if len(each) else np.empty(0, bool)
                numbers = {k: v[each] if k != "verified" else np.where(first, v[each], 0) for k, v in numbers.items()}
                yield pa.record_batch({"row": numbers["row"], "query_id": numbers["query_id"], "d2": np.concatenate([x[2] for x in out]), "vec_id": np.concatenate([x[3] for x in out]), "verified": numbers["verified"]})

    def answers(queries: DataFrame) -> DataFrame:
        """queries: cell, row, id, vector, within. Each goes to all deals of the cell."""
        sent = queries.join(F.broadcast(deals), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(1).alias("asked"), "row", "id", "vector", "within")
        together = dealt.join(sent.select("cell", "deal").distinct(), ["cell", "deal"], "left_semi").unionByName(sent)
        return together.repartition("cell", "deal").sortWithinPartitions("cell", "deal", "asked").mapInArrow(find, "row long, query_id long, d2 double, vec_id long, verified long")

    order = Window.partitionBy("row").orderBy("d2", "vec_id")
    work = F.sum("verified").over(Window.partitionBy("row")) if with_work else F.lit(0).cast("long")
    best = lambda found: found.withColumn("verified", work).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    home = materialize(best(answers(asking.select("cell", "row", "id", "vector", F.lit(None).cast("double").alias("within")))))
    kth = home.groupBy("row").agg(F.when(F.count("*") == k, F.max("d2")).alias("within"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch["vector"], size) @ matrix
            for i, (cell, within) in enumerate(zip(batch["cell"].to_pylist(), batch["within"].to_pylist(), strict=True)):
                near = cells.near(points[i], math.inf if within is None else ratio * within)
                others = near[near != cell]
                if len(others):
                    again = batch.take(pa.array([i] * len(others)))
                    yield pa.record_batch([pa.array(others, pa.int32()), *(again[c] for c in ("row", "id", "vector", "within"))], names=["cell", "row", "id", "vector", "within"])

    onward = asking.join(kth, "row", "left").select("cell", "row", "id", "vector", "within").mapInArrow(visit, "cell int, row long, id long, vector array<double>, within double")
    first = home.select("row", "query_id", "d2", "vec_id", F.when(F.col("rank") == 1, F.col("verified")).otherwise(0).alias("verified"))
    found = best(first.unionByName(answers(onward)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d2").alias("score"), *["verified"] * with_work)
