"""A perceptron for regression: squared loss through hidden layers, by L-BFGS on gradients that are summed over all rows.

A step is one pass over the rows, a written table: each task sums up the loss and its gradients over its rows, and the
sums are added up by weight. So many numbers as there are weights reach the driver, whatever the rows.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.boosting import _matrix
from ledgerline.operators.featuresets import aligned, standardizer
from ledgerline.sources.scratch import materialize

#: Steps of which L-BFGS remembers the changes.
MEMORY = 10


def _layers(weights: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def _forward(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """The values of each layer; hidden ones are bent by tanh."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.tanh(z) if i < len(layers) - 1 else z)
    return out


def _gradient(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the squared errors, summed, and their gradient by weight."""
    values = _forward(layers, x)
    error = values[-1] - y[:, None]
    loss, parts = float((error * error).sum() / 2), []
    for i in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate(((values[i].T @ error).ravel(), error.sum(axis=0))))
        if i:
            error = (error @ layers[i][0].T) * (1 - values[i] ** 2)
    return loss, np.concatenate(parts[::-1])


@dataclass(frozen=True)
class Perceptron:
    """columns with their means and scales, the target's mean and scale, the sizes of the layers and their weights."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    center: float
    spread: float
    sizes: tuple[int, ...]
    weights: tuple[float, ...]
    rounds: int
    losses: tuple[float, ...] = ()

    def scaled(self, rows: DataFrame) -> F.Column:
        aligned(rows, list(self.columns))
        return F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s for c, m, s in zip(self.columns, self.means, self.scales, strict=True)])

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds `prediction`. Nulls count as 0; an absent column is an error."""
        layers = _layers(np.array(self.weights), self.sizes)

        @F.arrow_udf("double")
        def predict(values: pa.Array) -> pa.Array:
            return pa.array(_forward(layers, _matrix(values, len(self.columns)))[-1][:, 0] * self.spread + self.center)

        return rows.withColumn("prediction", predict(self.scaled(rows)))

    def save(self, path: str) -> None:
        """One JSON file; what is there is replaced."""
        SparkSession.active().createDataFrame([(json.dumps(self.__dict__),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> Perceptron:
        told = json.loads(SparkSession.active().read.text(path).first()[0])
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.items()})


def _minimise(evaluate: Callable, weights: np.ndarray, rounds: int, keep_on: Callable) -> None:
    """L-BFGS with steps halved until the loss falls enough. keep_on(weights, loss, other) is asked after each round."""
    loss, gradient, other = evaluate(weights)
    past: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=MEMORY)
    if not keep_on(weights, loss, other):
        return
    for _ in range(rounds):
        direction, factors = gradient.copy(), []
        for s, y in reversed(past):
            factors.append((s @ direction) / (s @ y))
            direction -= factors[-1] * y
        if past:
            direction *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), f in zip(past, reversed(factors), strict=True):
            direction += (f - (y @ direction) / (s @ y)) * s
        slope, step = -(gradient @ direction), 1.0 if past else 1.0 / max(1.0, float(np.abs(gradient).sum()))
        if slope > -1e-12:
            return
        for _ in range(20):
            moved = weights - step * direction
            found = evaluate(moved)
            if found[0] <= loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return
        change = (moved - weights, found[1] - gradient)
        if change[0] @ change[1] > 1e-12:
            past.append(change)
        weights, (loss, gradient, other) = moved, found
        if not keep_on(weights, loss, other):
            return


def fit_perceptron(
    rows: DataFrame, columns: list[str], target: str, val: DataFrame | None = None, hidden: tuple[int, ...] = (32, 16), rounds: int = 100, patience: int = 8, decay: float = 1e-4, seed: int = 7
) -> Perceptron:
    """A perceptron on the mean squared error, with `decay` on the squared weights, for at most `rounds` rounds.

    Columns and target are scaled by mean and deviation of the training rows; nulls count as 0, rows without a target are
    left out. With val, fitting stops once its error has not fallen for `patience` rounds, and the weights of the lowest
    are kept. The first weights follow from the seed; sums are over all rows, so partitions change nothing but their last
    digits. Without rows the prediction is 0.
    """
    given = lambda df: aligned(df, [*columns, target]).filter(F.col(target).isNotNull()).fillna(0.0, subset=columns)
    data = given(rows)
    found = {r["feature"]: (r["mean"], r["scale"]) for r in standardizer(data, [*columns, target]).collect()}  # a row a column
    means, scales = ([float(found[c][i] or (0.0, 1.0)[i]) for c in [*columns, target]] for i in (0, 1))
    sizes = (len(columns), *hidden, 1)
    random = np.random.default_rng(seed)
    first = np.concatenate([np.concatenate((random.normal(0, 1 / np.sqrt(max(1, a)), a * b), np.zeros(b))) for a, b in zip(sizes[:-1], sizes[1:], strict=True)])
    bare = Perceptron(tuple(columns), tuple(means[:-1]), tuple(scales[:-1]), means[-1], scales[-1], sizes, (), 0)
    scaled = lambda df, held: df.select(bare.scaled(df).alias("x"), ((F.col(target).cast("double") - bare.center) / bare.spread).alias("y"), F.lit(held).alias("held"))
    table = materialize(scaled(data, False) if val is None else scaled(data, False).unionByName(scaled(given(val), True)))

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray, float | None]:
        """The training loss, its gradient, and the validation loss."""
        layers = _layers(weights, sizes)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Four sums before the gradient: loss and rows of training, squared errors and rows of validation.
            sums = np.zeros(4 + len(weights))
            for batch in batches:
                x, y, held = _matrix(batch["x"], len(columns)), batch["y"].to_numpy(), batch["held"].to_numpy(zero_copy_only=False)
                loss, gradient = _gradient(layers, x[~held], y[~held])
                other = _forward(layers, x[held])[-1][:, 0] - y[held]
                sums += np.concatenate(([loss, np.count_nonzero(~held), other @ other, np.count_nonzero(held)], gradient))
            yield pa.record_batch({"at": np.arange(len(sums)), "value": sums})

        summed = table.mapInArrow(task, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow().sort_by("at")["value"].to_numpy()
        n = max(1.0, summed[1]) if len(summed) else 1.0
        summed = summed if len(summed) else np.zeros(4 + len(weights))
        return summed[0] / n + decay / 2 * float(weights @ weights), summed[4:] / n + decay * weights, summed[2] / summed[3] if summed[3] else None

    best, done, losses = (np.inf, first, 0), [0], []

    def keep_on(weights: np.ndarray, loss: float, other: float | None) -> bool:
        nonlocal best
        measure = loss if other is None else other
        losses.append(float(measure))
        if measure < best[0]:
            best = (measure, weights, done[0])
        done[0] += 1
        return other is None or done[0] - 1 - best[2] < patience

    _minimise(evaluate, first, rounds, keep_on)
    return Perceptron(**(bare.__dict__ | {"weights": tuple(best[1].tolist()), "rounds": best[2], "losses": tuple(losses)}))
