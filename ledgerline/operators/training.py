"""Walk-forward training: every fold, model and feature set as a cell of its own, side by side, taken up again after a stop."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import boosting, metrics, models, perceptron
from ledgerline.operators.splits import FoldRules, Span, distinct_dates, final_fit
from ledgerline.sources.stages import run_stages


@dataclass(frozen=True)
class Recipe:
    """A model by name: what it predicts, and how it is fitted.

    fit(train, val, columns, target, rounds) returns what has `transform`, and for models that stop early `rounds`, the
    best number of them; val may be None, and rounds bounds them or, for None, leaves the model's own bound. `settings`
    is what else the fit follows from: a finished cell counts only for the same settings.
    """

    name: str
    task: str
    fit: Callable
    settings: dict = field(default_factory=dict)
    stops_early: bool = False


def _baseline(kind: type, train: DataFrame, val: DataFrame | None, columns: list[str], target: str, rounds: int | None):
    return kind() if kind is models.Zero else kind.fit(train.select(*columns, target).filter(F.col(target).isNotNull()), target)


def _regressor(kind: str, seed: int, train: DataFrame, val: DataFrame | None, columns: list[str], target: str, rounds: int | None):
    return models.fit_regressor(kind, train, columns, target, seed, val, **({} if rounds is None else {"rounds": rounds}))


def _classifier(kind: str, classes: int, seed: int, train: DataFrame, val: DataFrame | None, columns: list[str], target: str, rounds: int | None):
    return models.fit_classifier(kind, train, columns, target, classes, seed, val, **({} if rounds is None else {"rounds": rounds}))


def _softmax(classes: int, settings: dict, train: DataFrame, val: DataFrame | None, columns: list[str], target: str, rounds: int | None):
    return boosting.fit_softmax_trees(train, columns, target, classes, val=val, **(settings | ({} if rounds is None else {"rounds": rounds})))


def _perceptron(settings: dict, train: DataFrame, val: DataFrame | None, columns: list[str], target: str, rounds: int | None):
    return perceptron.fit_perceptron(train, columns, target, val=val, **(settings | ({} if rounds is None else {"rounds": rounds})))


def regression_recipe(kind: str, seed: int = 7, **settings) -> Recipe:
    """zero, mean, momentum, ridge, elastic_net, boosted_trees or perceptron."""
    simple = {"zero": models.Zero, "mean": models.Mean, "momentum": models.Momentum}
    if kind in simple:
        return Recipe(kind, "regression", partial(_baseline, simple[kind]))
    settings = settings | {"seed": seed}
    fit = partial(_perceptron, settings) if kind == "perceptron" else partial(_regressor, kind, seed)
    return Recipe(kind, "regression", fit, settings, kind in ("boosted_trees", "perceptron"))


def classification_recipe(kind: str, classes: int, seed: int = 7, **settings) -> Recipe:
    """logistic, elastic_net_logistic, forest, boosted_trees, perceptron or softmax_trees."""
    fit = partial(_softmax, classes, settings) if kind == "softmax_trees" else partial(_classifier, kind, classes, seed)
    return Recipe(kind, "classification", fit, settings | {"classes": classes, "seed": seed}, kind in ("boosted_trees", "softmax_trees"))


def _between(rows: DataFrame, span: Span | None, date: str) -> DataFrame | None:
    return None if span is None else rows.filter(F.col(date).between(span.first, span.last))


def _predict(rows: DataFrame, recipe: Recipe, spans: dict[str, Span], columns: list[str], target: str, date: str, keep: list[str]) -> DataFrame:
    """Fits on the fold's training rows and predicts its other splits."""
    known = rows.filter(F.col(target).isNotNull())
    model = recipe.fit(_between(known, spans["train"], date), _between(known, spans.get("val"), date), columns, target, None)
    out = "prediction" if recipe.task == "regression" else "probabilities"
    parts = [model.transform(_between(known, s, date)).select(*keep, F.lit(name).alias("split"), out, F.col(target).alias("actual")) for name, s in spans.items() if name != "train"]
    return reduce(DataFrame.unionByName, parts)


def _measure(predictions: DataFrame, recipe: Recipe, splits: list[str], date: str, unique: str, realized: str | None) -> DataFrame:
    """A row a split. The predictions are a written table."""
    if recipe.task == "regression":
        found = metrics.regression_metrics(predictions, date, unique, by="split")
        each = predictions.sparkSession.range(0, 1, 1, 1).select(F.explode(F.lit(splits)).alias("split"))
        named = each.join(found.hint("merge"), "split", "left").fillna(0, ["row_count", "date_count"])  # a split may have no rows
        return named.select(*[c for c in found.columns if c != "split"], "split")
    measured = []
    for name in splits:
        own = predictions.filter(F.col("split") == name)
        measured.append(metrics.classification_metrics(own, recipe.settings["classes"], date, unique, realized).withColumn("split", F.lit(name)))
    return reduce(DataFrame.unionByName, measured)


def train_walk_forward(
    rows: DataFrame, spans: list[Span], recipes: list[Recipe], feature_sets: dict[str, list[str]], target: str, folder: str, made_of: dict,
    side_by_side: int = 4, resume: bool = True, date: str = "date", unique: str = "ticker", realized: str | None = None,
) -> DataFrame:
    """Metrics of each model and feature set on each fold's validation and test rows: a row a cell and split.

    rows: date, unique, the feature sets' columns, the target and, for classification, perhaps the realized return; they
    are written once, by date, so that a fold reads the files of its dates. A cell is a fold, a recipe and a feature set:
    it fits on the fold's training rows, may stop early by its validation rows, and keeps its predictions and metrics in
    the folder. made_of tells what the rows are made of. A run with the same made_of, columns and recipe takes finished
    cells as they are, so one that broke off goes on; the others run from a pool of threads, each with a scheduler pool
    of its own. If a cell fails, the others are finished before its error is raised.
    """
    spark = rows.sparkSession
    columns = list(dict.fromkeys(c for s in feature_sets.values() for c in s))
    kept = list(dict.fromkeys([date, unique, *columns, target, *([realized] if realized else [])]))
    base = made_of | {"columns": kept}
    data = run_stages(spark, rows, [("rows", lambda _, r: r.select(*kept).repartitionByRange(date).sortWithinPartitions(date, unique))], folder, base, resume)
    folds: dict[int, dict[str, Span]] = {}
    for s in spans:
        folds.setdefault(s.fold, {})[s.split] = s
    cells = [(fold, recipe, name) for fold in sorted(folds) for recipe in recipes for name in feature_sets]

    def cell(fold: int, recipe: Recipe, name: str) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{recipe.name}-{name}-{fold}")
        own = folds[fold]
        keep = [date, unique, *([realized] if realized else [])]
        stages = [
            ("predictions", lambda _, r: _predict(r, recipe, own, feature_sets[name], target, date, keep)),
            ("metrics", lambda _, r: _measure(r, recipe, [s for s in own if s != "train"], date, unique, realized)),
        ]
        told = base | {"model": recipe.name, "task": recipe.task, "settings": recipe.settings, "set": feature_sets[name], "spans": sorted(map(str, own.values())), "realized": realized}
        found = run_stages(spark, data, stages, f"{folder.rstrip('/')}/cells/fold_{fold}/{recipe.name}/{name}", told, resume)
        return found.withColumns({"fold_id": F.lit(fold), "model_name": F.lit(recipe.name), "feature_set": F.lit(name), "target": F.lit(target)})

    with ThreadPoolExecutor(max(1, side_by_side)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(partial(cell, *c))) for c in cells]
    return reduce(DataFrame.unionByName, [r.result() for r in running])


def fit_final(rows: DataFrame, recipe: Recipe, columns: list[str], target: str, rules: FoldRules = FoldRules(), date: str = "date"):
    """The model to deploy: fitted on all dates, for as many rounds as were best on the last block of dates.

    A model that does not stop early is fitted on all dates at once.
    """
    known = rows.filter(F.col(target).isNotNull())
    if not recipe.stops_early:
        return recipe.fit(known, None, columns, target, None)
    spans = {s.split: s for s in final_fit(distinct_dates(known, date), rules)}
    early = recipe.fit(_between(known, spans["train"], date), _between(known, spans["val"], date), columns, target, None)
    return recipe.fit(_between(known, spans["refit"], date), None, columns, target, getattr(early, "rounds", None))
