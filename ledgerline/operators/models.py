"""Baseline models: zero, mean and momentum exactly, linear and tree models by Spark ML, and a fallback for one class."""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.featuresets import aligned, standardizer


@dataclass(frozen=True)
class Zero:
    """Predicts 0."""

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", F.lit(0.0))

    transform = predict


@dataclass(frozen=True)
class Mean:
    """Predicts the training mean."""

    mean: float | None

    @classmethod
    def fit(cls, rows: DataFrame, target: str) -> Mean:
        return cls(rows.agg(F.avg(target)).first()[0])

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", F.lit(self.mean).cast("double"))

    transform = predict


@dataclass(frozen=True)
class Momentum:
    """Predicts the mean of the momentum columns, scaled to the target's deviation; the target's mean without such columns."""

    columns: tuple[str, ...]
    scale: float
    mean: float | None

    @classmethod
    def fit(cls, rows: DataFrame, target: str) -> Momentum:
        columns = [c for c in rows.columns if c.endswith(("momentum_20d__last", "rolling_return_20d__last"))] or [c for c in rows.columns if "momentum_20d" in c or "rolling_return_20d" in c]
        if not columns:
            return cls((), 1.0, rows.agg(F.avg(target)).first()[0])
        y, s, mean = rows.agg(F.stddev_pop(target), F.stddev_pop(_signal(columns)), F.avg(target)).first()
        return cls(tuple(columns), 1.0 if y is None else y / (s or 1.0), mean)

    def predict(self, rows: DataFrame) -> DataFrame:
        here = [c for c in self.columns if c in rows.columns]
        return rows.withColumn("prediction", _signal(here) * self.scale if here else F.lit(self.mean).cast("double"))

    transform = predict


def _signal(columns: list[str]):
    """The mean of a row's values that are not null, 0 if all are."""
    given = [F.col(c).isNotNull().cast("int") for c in columns]
    return F.coalesce(sum(F.coalesce(F.col(c), F.lit(0.0)) for c in columns) / F.nullif(sum(given), F.lit(0)), F.lit(0.0))


@dataclass(frozen=True)
class Fitted:
    """A model with the columns that it takes, in order, and how they are scaled: by mean and population deviation."""

    kind: str
    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    model: object

    @property
    def rounds(self) -> int | None:
        """The trees of a boosted model, one after the other; None for other kinds."""
        return self.model.getNumTrees if self.kind == "boosted_trees" else None

    def features(self, rows: DataFrame) -> DataFrame:
        """The rows with `features`: the columns as a vector, nulls as 0; an absent column is an error.

        The vector's length is told beside it, as by Spark's assembler: else a fit reads rows for it."""
        from pyspark.ml.functions import array_to_vector

        aligned(rows, list(self.columns))
        scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s for c, m, s in zip(self.columns, self.means, self.scales, strict=True)]
        return rows.withColumn("features", array_to_vector(F.array(*scaled))).withMetadata("features", {"ml_attr": {"num_attrs": len(scaled)}})

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds `prediction`, or for a classifier `probabilities` as an array."""
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self.features(rows)).drop("features")
        if "probability" not in out.columns:
            return out
        return out.withColumn("probabilities", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        """The model and, beside it, a JSON file of the rest; what is there is replaced."""
        spark = SparkSession.active()
        rest = {"kind": self.kind, "columns": self.columns, "means": self.means, "scales": self.scales, "model": f"{type(self.model).__module__}.{type(self.model).__name__}"}
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/fitted")

    @classmethod
    def load(cls, path: str) -> Fitted:
        """Only Spark's own models are read."""
        rest = json.loads(SparkSession.active().read.text(f"{path}/fitted").first()[0])
        module, _, name = rest["model"].rpartition(".")
        if module not in ("pyspark.ml.regression", "pyspark.ml.classification"):
            raise ValueError(f"not a model of Spark: {rest['model']}")
        model = getattr(importlib.import_module(module), name).load(f"{path}/model")
        return cls(rest["kind"], tuple(rest["columns"]), tuple(rest["means"]), tuple(rest["scales"]), model)


def _scaled(kind: str, data: DataFrame, columns: list[str], also: dict[str, Column] | None = None) -> tuple[Fitted, Row]:
    """Not fitted yet: the columns' scales by one pass of partial sums over data, nulls as 0. Beside it a row with the
    aggregates `also` of that pass."""
    found = standardizer(data.fillna(0.0, subset=columns), columns, also).collect()  # a row a column
    by = {r.feature: (r["mean"], r.scale) for r in found}
    return Fitted(kind, tuple(columns), *(tuple(float(by[c][i] or 0.0) if i == 0 else float(by[c][i] or 1.0) for c in columns) for i in (0, 1)), None), found[0]


def _fit(bare: Fitted, data: DataFrame, estimator, val: DataFrame | None = None) -> Fitted:
    """Rows of val only tell when to stop."""
    if val is None:
        return replace(bare, model=estimator.fit(bare.features(data)))
    both = data.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)))
    stops = {estimator.validationIndicatorCol: "_val", estimator.validationTol: VALIDATION_TOLERANCE}
    return replace(bare, model=estimator.fit(bare.features(both), stops))


#: Boosting stops once a round lowers the validation loss by less than this share of it.
VALIDATION_TOLERANCE = 1e-4


def fit_regressor(kind: str, rows: DataFrame, columns: list[str], target: str, seed: int = 7, val: DataFrame | None = None, rounds: int = 50) -> Fitted:
    """ridge (a penalty of 10 on the summed loss), elastic_net (0.005, a fifth of it absolute, on the mean loss) or boosted_trees.

    Spark's squared loss is halved and averaged, and its squared penalty divided by the target's deviation. Boosting takes
    at most `rounds` rounds; with val, which other kinds leave aside, no more than lower its loss.
    """
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    given = lambda df: aligned(df, [*columns, target]).filter(F.col(target).isNotNull())
    data = given(rows)
    if kind == "boosted_trees":
        model = GBTRegressor(labelCol=target, maxDepth=4, maxIter=rounds, stepSize=0.03, subsamplingRate=0.8, seed=seed)
        return _fit(_scaled(kind, data, columns)[0], data, model, None if val is None else given(val))
    bare, whole = _scaled(kind, data, columns, {"_n": F.count("*"), "_deviation": F.stddev_pop(target)})
    absolute, squared = {"ridge": (0.0, 10.0 / max(1, whole["_n"])), "elastic_net": (0.001, 0.004)}[kind]
    penalty = absolute + squared * (whole["_deviation"] or 1.0)
    return _fit(bare, data, LinearRegression(labelCol=target, regParam=penalty, elasticNetParam=absolute / penalty, standardization=False, tol=1e-9))


@dataclass(frozen=True)
class OneClass:
    """For training rows of one class only: that class for sure."""

    label: int
    classes: int

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("probabilities", F.array(*[F.lit(1.0 if i == self.label else 0.0) for i in range(self.classes)]))


def fit_classifier(kind: str, rows: DataFrame, columns: list[str], label: str, classes: int, seed: int = 7, val: DataFrame | None = None, rounds: int = 50) -> Fitted | OneClass:
    """logistic, elastic_net_logistic, forest, boosted_trees (two classes) or perceptron, with balanced weights where Spark
    takes them; OneClass if the labels do not differ. val and rounds are for boosting, as in fit_regressor."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier

    given = lambda df: aligned(df, [*columns, label]).filter(F.col(label).isNotNull())
    data = given(rows)
    sizes = {int(r[0]): r[1] for r in data.groupBy(label).count().collect()}  # a row a class
    if len(sizes) < 2:
        return OneClass(next(iter(sizes), 0), classes)
    total = sum(sizes.values())
    weight = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (float(k), total / (len(sizes) * n))])[F.col(label).cast("double")]
    model = {
        "logistic": lambda: LogisticRegression(labelCol=label, weightCol="_weight", regParam=1.0 / total, standardization=False),
        "elastic_net_logistic": lambda: LogisticRegression(labelCol=label, weightCol="_weight", regParam=0.0005, elasticNetParam=0.15, standardization=False),
        "forest": lambda: RandomForestClassifier(labelCol=label, weightCol="_weight", numTrees=50, maxDepth=6, seed=seed),
        "boosted_trees": lambda: GBTClassifier(labelCol=label, weightCol="_weight", maxDepth=4, maxIter=rounds, stepSize=0.03, subsamplingRate=0.8, seed=seed),
        "perceptron": lambda: MultilayerPerceptronClassifier(labelCol=label, layers=[len(columns), 64, 32, classes], maxIter=60, seed=seed),
    }[kind]()
    stop = given(val).withColumn("_weight", F.coalesce(weight, F.lit(1.0))) if val is not None and kind == "boosted_trees" else None
    weighted = data.withColumn("_weight", weight)
    return _fit(_scaled(kind, weighted, columns)[0], weighted, model, stop)
