"""Gradient-boosted trees for several classes by softmax, with histograms as grouped aggregates.

Features are cut into bins of about as many rows each. A round grows a tree a class, level by level: tasks sum up the
gradients and hessians of their rows by class, node, feature and bin, the sums are added up by these, and so many as
there are bins, whatever the rows, reach the driver, which picks each node's best split. Rows are a written table of
bins and scores; trees are small and go to the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.featuresets import aligned
from ledgerline.sources.scratch import materialize

#: Rounds after which the rows' scores are written anew, so that a task adds up no more trees than these.
WRITTEN = 16


@dataclass(frozen=True)
class Tree:
    """Nodes by place, the two below node i at 2i + 1 and 2i + 2; feature -1 is a leaf. Rows in bins up to `cut` go left."""

    feature: tuple[int, ...]
    cut: tuple[int, ...]
    value: tuple[float, ...]

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        feature, cut = np.array(self.feature), np.array(self.cut)
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > cut[at]), at)
        return at

    def values(self, bins: np.ndarray, levels: int) -> np.ndarray:
        return np.array(self.value)[self.places(bins, levels)]


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _filled(columns: list[str]) -> Column:
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type = float) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


@dataclass(frozen=True)
class SoftmaxTrees:
    """columns in order, each one's upper bin edges, the scores to start from, and a tree a class for each round."""

    columns: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    start: tuple[float, ...]
    trees: tuple[tuple[Tree, ...], ...]
    depth: int
    losses: tuple[float, ...] = ()

    @property
    def rounds(self) -> int:
        return len(self.trees)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """The first bin whose edge is not below the value; the last has no edge."""
        return np.stack([np.searchsorted(e, values[:, i], "left") for i, e in enumerate(self.edges)], axis=1) if len(self.edges) else values.astype(np.int64)

    def added(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        """What the trees of the rounds from `since` on add to the scores."""
        out = np.zeros((len(bins), len(self.start)))
        for trees in self.trees[since:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.values(bins, self.depth)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds `probabilities`, an array by class. Nulls and NaNs count as 0; an absent column is an error."""
        aligned(rows, list(self.columns))

        @F.arrow_udf("array<double>")
        def predict(values: pa.Array) -> pa.Array:
            bins = self.bins(_matrix(values, len(self.columns)))
            found = _softmax(np.array(self.start) + self.added(bins))
            return pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(self.start), dtype=np.int32), pa.array(found.ravel()))

        return rows.withColumn("probabilities", predict(_filled(list(self.columns))))

    def save(self, path: str) -> None:
        """One JSON file; what is there is replaced."""
        told = {"columns": self.columns, "edges": self.edges, "start": self.start, "depth": self.depth, "losses": self.losses, "trees": [[[t.feature, t.cut, t.value] for t in trees] for trees in self.trees]}
        SparkSession.active().createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> SoftmaxTrees:
        told = json.loads(SparkSession.active().read.text(path).first()[0])
        trees = tuple(tuple(Tree(*map(tuple, t)) for t in trees) for trees in told["trees"])
        return cls(tuple(told["columns"]), tuple(map(tuple, told["edges"])), tuple(told["start"]), trees, told["depth"], tuple(told["losses"]))


def bin_edges(rows: DataFrame, columns: list[str], bins: int) -> tuple[tuple[float, ...], ...]:
    """Up to bins - 1 edges a column, by approximate quantiles in one pass; distinct values, if there are few."""
    shares = [(i + 1) / bins for i in range(bins)]
    found = rows.select(F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(columns) - 1)).alias("i"), _filled(columns).alias("x")))).groupBy("i").agg(F.percentile_approx("x", shares, 10_000).alias("q")).collect()
    edges = {r["i"]: sorted(set(r["q"])) for r in found}  # a row a column
    return tuple(tuple(edges.get(i, ())[:-1]) for i in range(len(columns)))


def _best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, penalty: float, least: int) -> tuple[int, int] | None:
    """g, h, n by feature and bin. The feature and bin after which a cut gains most, the first of equal ones; None if none gains."""
    left = [np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n)]
    right = [x.sum(axis=1, keepdims=True) - y for x, y in zip((g, h, n), left, strict=True)]
    gain = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - g[:1].sum() ** 2 / (h[:1].sum() + penalty)
    gain[(left[2] < least) | (right[2] < least)] = -np.inf
    if not gain.size or not gain.max() > 1e-9:
        return None
    # Sums are added in any order: gains that differ by no more than that are equal.
    at = int(np.argmax(gain >= gain.max() * (1 - 1e-9)))
    return at // gain.shape[1], at % gain.shape[1]


def fit_softmax_trees(
    rows: DataFrame, columns: list[str], label: str, classes: int, val: DataFrame | None = None, rounds: int = 50, depth: int = 3, rate: float = 0.1, bins: int = 32, penalty: float = 1.0, least: int = 5, patience: int = 5, balanced: bool = True
) -> SoftmaxTrees:
    """Boosted trees by Newton steps on the multinomial loss, at most `rounds` rounds of a tree a class.

    rows: the columns (nulls and NaNs count as 0) and the label, 0 to classes - 1; rows without a label are left out. With
    val, training stops once its log loss has not fallen for `patience` rounds, and the rounds up to the lowest are kept.
    balanced weighs each class alike. Where no rows or one class are given, the model has no trees and gives the classes'
    shares. A node keeps `least` rows on either side of a cut.
    """
    given = lambda df, held: aligned(df, [*columns, label]).filter(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), _filled(columns).alias("x"), F.lit(held).alias("held"))
    data = given(rows, False)
    sizes = {r["y"]: r["count"] for r in data.groupBy("y").count().collect()}  # a row a class
    if any(not 0 <= y < classes for y in sizes):
        raise ValueError(f"labels {sorted(sizes)} are not all below {classes}")
    total = sum(sizes.values())
    weights = np.array([total / (len(sizes) * sizes[k]) if balanced and k in sizes else 1.0 for k in range(classes)])
    shares = np.array([sizes.get(k, 0) * weights[k] for k in range(classes)]) if total else np.ones(classes)
    start = np.log(np.maximum(shares / shares.sum(), 1e-12))
    model = SoftmaxTrees(tuple(columns), bin_edges(rows.filter(F.col(label).isNotNull()), columns, bins) if total else ((),) * len(columns), tuple(start.tolist()), (), depth)
    if len(sizes) < 2:
        return model
    width, both = len(columns), data if val is None else data.unionByName(given(val, True))
    binned, edged = model, max(len(e) for e in model.edges) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = binned.bins(_matrix(batch["x"], width)).astype(np.int16)
            scores = np.tile(start, (len(found), 1))
            lists = [pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel())) for m in (found, scores)]
            yield pa.record_batch([batch["y"], batch["held"], *lists], names=["y", "held", "bins", "scores"])

    table = materialize(both.mapInArrow(cut, "y int, held boolean, bins array<smallint>, scores array<double>"))
    written, losses, best = 0, [], (np.inf, 0)

    def sums(now: SoftmaxTrees, growing: list[Tree], level: int, since: int) -> dict[int, tuple[np.ndarray, ...]]:
        """For each class and node of a level g, h and n by feature and bin; under -1 the validation loss and rows."""
        nodes = 2**level

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(2)
            out = np.zeros((3, classes * nodes * width * edged))
            for batch in batches:
                y, apart = batch["y"].to_numpy(), batch["held"].to_numpy(zero_copy_only=False)
                own = _matrix(batch["bins"], width, np.int64)
                p = _softmax(_matrix(batch["scores"], classes) + now.added(own, since))
                held += (-(weights[y] * np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)))[apart].sum(), weights[y][apart].sum())
                p, y, own = p[~apart], y[~apart], own[~apart]
                for k in range(classes):
                    at = growing[k].places(own, level) - (nodes - 1)
                    here = at >= 0
                    w = weights[y[here]]
                    g, h = w * (p[here, k] - (y[here] == k)), w * p[here, k] * (1 - p[here, k])
                    cells = (((k * nodes + at[here]) * width)[:, None] + np.arange(width)) * edged + own[here]
                    for i, values in enumerate((g, h, None)):
                        out[i] += np.bincount(cells.ravel(), None if values is None else np.repeat(values, width), out.shape[1])
            used = np.flatnonzero(out[2])
            yield pa.record_batch({"cell": np.append(used, -1), "g": np.append(out[0][used], held[0]), "h": np.append(out[1][used], held[1]), "n": np.append(out[2][used], 0.0)})

        found = table.mapInArrow(task, "cell long, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow().sort_by("cell").to_pydict()
        held = (found["g"][0], found["h"][0])
        whole = np.zeros((3, classes * nodes * width * edged))
        whole[:, found["cell"][1:]] = [found[c][1:] for c in "ghn"]
        return {-1: held} | dict(enumerate(whole.reshape(3, classes * nodes, width, edged).transpose(1, 0, 2, 3)))

    def missed(found: dict) -> bool:
        """Notes the validation loss of all rounds so far; whether it is time to stop."""
        nonlocal best
        if val is None or not found[-1][1]:
            return False
        losses.append(found[-1][0] / found[-1][1])
        if losses[-1] < best[0] - 1e-9:
            best = (losses[-1], model.rounds)
        return model.rounds - best[1] >= patience

    while model.rounds < rounds:
        size = 2 ** (depth + 1) - 1
        grown = [Tree((-1,) * size, (0,) * size, (0.0,) * size) for _ in range(classes)]
        for level in range(depth):
            found = sums(model, grown, level, written)
            if level == 0 and missed(found):
                break
            for k in range(classes):
                feature, cuts, value = (list(x) for x in (grown[k].feature, grown[k].cut, grown[k].value))
                for node in range(2**level):
                    g, h, n = found[k * 2**level + node]
                    split = _best_split(g, h, n, penalty, least)
                    if split is None:
                        continue
                    f, b = split
                    at = 2**level - 1 + node
                    feature[at], cuts[at] = f, b
                    for below, part in ((2 * at + 1, slice(0, b + 1)), (2 * at + 2, slice(b + 1, None))):
                        value[below] = float(-rate * g[f, part].sum() / (h[f, part].sum() + penalty))
                grown[k] = Tree(tuple(feature), tuple(cuts), tuple(value))
        else:
            if all(t.feature[0] < 0 for t in grown):
                break
            model = replace(model, trees=(*model.trees, tuple(grown)))
            if model.rounds - written >= WRITTEN and model.rounds < rounds:
                done, since, written = model, written, model.rounds

                def score(batches: Iterator[pa.RecordBatch], done: SoftmaxTrees = done, since: int = since) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        more = _matrix(batch["scores"], classes) + done.added(_matrix(batch["bins"], width, np.int64), since)
                        lists = pa.ListArray.from_arrays(np.arange(0, more.size + 1, classes, dtype=np.int32), pa.array(more.ravel()))
                        yield pa.record_batch([batch["y"], batch["held"], batch["bins"], lists], names=["y", "held", "bins", "scores"])

                table = materialize(table.mapInArrow(score, table.schema))
            continue
        break
    if val is not None and best[0] < np.inf:
        if len(losses) <= model.rounds:
            missed(sums(model, [Tree((-1,), (0,), (0.0,))] * classes, 0, written))
        model = replace(model, trees=model.trees[: best[1]])
    return replace(model, losses=tuple(losses))
