"""Evaluation of predictions: rank correlation, spreads, precision, ranking areas, losses and leaderboards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerline.functions.scalars import argmax, clipped_probabilities
from ledgerline.operators.sliding import dealt, whole_groups
from ledgerline.sources.scratch import materialize


def _daily(rows: pa.Table) -> tuple[float | None, float | None]:
    """ic and spread of one date's rows, in the order of `unique`."""
    n = rows.num_rows
    if n < 10:
        return None, None
    (pred, given), (actual, known) = ((rows[c].to_numpy(), rows[c].is_valid().to_numpy()) for c in ("prediction", "actual"))
    both = given & known & ~np.isnan(pred) & ~np.isnan(actual)
    # All sorts are stable, so ties rank by `unique`; nulls come first and NaN last.
    rank = lambda x: np.argsort(np.argsort(x, kind="stable"))
    ic = float(np.corrcoef(rank(pred[both]), rank(actual[both]))[0, 1]) if both.sum() >= 3 else None
    order, q = np.lexsort((pred, given)), int(max(np.floor(n * 0.2), 1))
    bottom, top = (actual[some][known[some]] for some in (order[:q], order[n - q :]))
    return ic, float(top.mean() - bottom.mean()) if len(top) and len(bottom) else None


def regression_metrics(rows: DataFrame, date: str = "anchor_date", unique: str = "ticker", by: str | None = None) -> DataFrame:
    """rows: date, unique, prediction, actual. One row: rmse, mae, rank_ic, directional_hit_rate, top_bottom_spread, counts.

    rank_ic is the mean over dates with ten rows or more of the correlation of ordinal ranks; the spread compares the
    top fifth with the bottom fifth of each such date. Ties rank by `unique`.

    The rows are written once, narrow, sorted once, and ranked by numpy on batches of whole dates. With `by`, a column of
    a few values without nulls, there is a row a value, with it, and the rows, which come from a written table, are not written again.
    """
    keys = [by] if by else []
    rows = rows.select(*keys, date, unique, *[F.col(c).cast("double").alias(c) for c in ("prediction", "actual")])
    rows = rows if by else materialize(rows)
    pred, actual = F.col("prediction"), F.col("actual")
    error = pred - actual
    whole = rows.groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(F.coalesce(F.signum(pred) == F.signum(actual), F.lit(False)).cast("double")).alias("directional_hit_rate"),
        F.count("*").alias("row_count"),
        F.countDistinct(date).alias("date_count"),
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            opens = np.flatnonzero(table["_row"].to_numpy() == 1)
            found = [_daily(table.slice(i, n)) for i, n in zip(opens.tolist(), np.diff(opens, append=table.num_rows).tolist(), strict=True)]
            days = [table[c].take(pa.array(opens)).combine_chunks() for c in (*keys, date)]
            yield pa.record_batch([*days, *(pa.array([x[i] for x in found], pa.float64()) for i in (0, 1))], names=[*keys, date, "ic", "spread"])

    numbered = dealt(rows, rows.count(), *keys, date).withColumn("_row", F.row_number().over(Window.partitionBy(*keys, date).orderBy(unique)))
    daily = numbered.mapInArrow(task, StructType([*(rows.schema[c] for c in (*keys, date)), StructField("ic", DoubleType()), StructField("spread", DoubleType())]))
    means = daily.groupBy(*keys).agg(F.avg("ic").alias("rank_ic"), F.avg("spread").alias("top_bottom_spread"))
    # Both are dealt by `by`: a merge of a few rows, where a broadcast would hold a page of memory for each run.
    return whole.join(means.hint("merge"), by) if by else beside(whole, means)


#: Ranges of scores over which running sums are first taken.
RANGES = 256


def ranking_areas(rows: DataFrame) -> DataFrame:
    """rows: score, positive (0/1). One row: pr_auc (average precision over distinct scores) and roc_auc (ties count half).

    Rows are first summed up by score, and the scores dealt to ranges of about as many scores each, written as they are
    dealt. Running sums are taken within ranges, and over the ranges' totals, so no task sorts all scores, however they
    lie.
    """
    by = rows.groupBy("score").agg(F.sum("positive").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    ranged = materialize(by.repartitionByRange(RANGES, F.desc("score")).withColumn("part", F.spark_partition_id()))
    ends = ranged.agg(F.struct(F.sum("p").alias("tp"), F.sum("n").alias("tn"))).scalar()
    within = Window.partitionBy("part").orderBy(F.desc("score"))
    summed = ranged.withColumns({"cp": F.sum("p").over(within), "cn": F.sum("n").over(within), "_e": ends})
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = ranged.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn")).select("part", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(o) for c, o in (("sp", "op"), ("sn", "on"))])
    whole = summed.join(F.broadcast(offsets), "part").withColumns({"cp": F.col("cp") + F.col("op"), "cn": F.col("cn") + F.col("on"), "tp": F.col("_e.tp"), "tn": F.col("_e.tn") - F.col("_e.tp")})
    higher = F.col("cp") - F.col("p")
    return whole.agg(
        F.sum(F.col("p") / F.nullif(F.col("tp"), F.lit(0.0)) * F.col("cp") / F.col("cn")).alias("pr_auc"),
        F.sum((F.col("n") - F.col("p")) * (higher + F.col("p") / 2) / F.nullif(F.col("tp") * F.col("tn"), F.lit(0.0))).alias("roc_auc"),
    )


def beside(one: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row frames side by side, the others as scalar subqueries."""
    out = one
    for i, other in enumerate(others):
        out = out.withColumn(f"_{i}", other.select(F.struct(*other.columns).alias("s")).scalar())
    return out.select(*one.columns, *[F.col(f"_{i}.{c}").alias(c) for i, other in enumerate(others) for c in other.columns])


def classification_metrics(rows: DataFrame, classes: int, date: str = "anchor_date", unique: str = "ticker", realized: str | None = None) -> DataFrame:
    """rows: date, unique, probabilities (array), actual (class). One row of metrics; the last class is the positive one.

    The scored rows are written once, narrow, and all metrics read them.
    """
    scored = rows.withColumn("_prob", clipped_probabilities(F.col("probabilities"))).withColumns(
        {"score": F.element_at("_prob", classes), "_label": argmax(F.col("_prob")), "positive": (F.col("actual") == classes - 1).cast("int")}
    )
    scored = materialize(scored.select(date, unique, "actual", "_prob", "score", "_label", "positive", *([realized] if realized else [])))
    hit = F.col("_label") == F.col("actual")
    k = range(classes)
    sums = scored.agg(
        F.avg(hit.cast("double")).alias("accuracy"),
        F.avg(F.col("positive").cast("double")).alias("positive_rate"),
        F.avg(-F.log(F.element_at("_prob", F.col("actual").cast("int") + 1))).alias("multiclass_log_loss"),
        *[F.avg((F.col("actual") == i).cast("double")).alias(f"class_{i}_rate") for i in k],
        *[F.avg((F.col("_label") == i).cast("double")).alias(f"pred_class_{i}_rate") for i in k],
        *[F.avg(((F.col("_label") == i) & hit).cast("double")).alias(f"_hit_{i}") for i in k],
        F.count("*").alias("row_count"),
        F.countDistinct(date).alias("date_count"),
    )
    f1 = sum(F.coalesce(2 * F.col(f"_hit_{i}") / F.nullif(F.col(f"class_{i}_rate") + F.col(f"pred_class_{i}_rate"), F.lit(0.0)), F.lit(0.0)) for i in k) / classes
    place = F.row_number().over(Window.partitionBy(date).orderBy("score", unique))
    ranked = scored.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(date)), "_place": place}).filter("_n >= 10")
    q = F.greatest(F.ceil(F.col("_n") * 0.1), F.lit(1))
    top, bottom = F.col("_place") > F.col("_n") - q, F.col("_place") <= q
    gap = lambda c: F.avg(F.when(top, c)) - F.avg(F.when(bottom, c))
    daily = ranked.groupBy(date).agg(F.avg(F.when(top, F.col("positive"))).alias("precision"), gap(F.col("positive")).alias("events"), (gap(F.col(realized)) if realized else F.lit(None).cast("double")).alias("spread"))
    means = daily.agg(F.avg("precision").alias("top_decile_precision"), F.avg("spread").alias("top_bottom_spread"), F.avg("events").alias("top_bottom_event_rate_spread"))
    out = sums.withColumn("macro_f1", f1).drop(*[f"_hit_{i}" for i in k])
    return beside(out, means, ranking_areas(scored.select("score", "positive")))


def leaderboard(metrics: DataFrame, kind: str, split: str = "val") -> DataFrame:
    """model_name, feature_set, mean metrics, selection_score, leaderboard_rank, recommended (the first three).

    kind: regression (rank correlation plus spread; targets of one day count only if there are no others) or
    classification (average precision plus top-decile precision plus spread). Ties, which are values that agree to nine
    digits, rank by name.
    """
    rows = metrics.filter(F.col("split") == split)
    if kind == "regression":
        long = ~F.col("target").endswith("_1d")
        rows = rows.filter(long | ~rows.agg(F.coalesce(F.max(long), F.lit(False)).alias("any")).scalar())
        names = {"mean_rank_ic": "rank_ic", "mean_top_bottom_spread": "top_bottom_spread", "mean_rmse": "rmse", "mean_mae": "mae"}
        main, extra, order = "mean_rank_ic", ["mean_top_bottom_spread"], ["mean_rank_ic", "mean_top_bottom_spread"]
    else:
        names = {f"mean_{n}": n for n in ("pr_auc", "roc_auc", "top_decile_precision", "top_bottom_spread", "accuracy", "positive_rate")}
        main, extra, order = "mean_pr_auc", ["mean_top_decile_precision", "mean_top_bottom_spread"], ["mean_pr_auc", "mean_roc_auc", "mean_top_decile_precision", "mean_top_bottom_spread"]
    means = rows.groupBy("model_name", "feature_set").agg(*[F.avg(c).alias(n) for n, c in names.items()])
    score = F.coalesce(main, F.lit(-999.0))
    for c in extra:
        score = score + F.coalesce(c, F.lit(0.0))
    near = lambda c: F.round(c, 9).desc_nulls_last()
    ranks = Window.orderBy(near("selection_score"), *[near(c) for c in order], "model_name", "feature_set")
    out = means.withColumn("selection_score", score).withColumn("leaderboard_rank", F.row_number().over(ranks))
    return out.withColumns({"recommended": F.col("leaderboard_rank") <= 3, "source_split": F.lit(split)})


def family_rank(board: DataFrame) -> DataFrame:
    """Adds each entry's place within its model, by the leaderboard's order."""
    return board.withColumn("family_rank", F.row_number().over(Window.partitionBy("model_name").orderBy("leaderboard_rank")))


def compare_boards(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Entries that both boards have, with each metric's change."""
    both = old.select("model_name", "feature_set", *[F.col(c).alias(f"old_{c}") for c in columns]).join(new.select("model_name", "feature_set", *[F.col(c).alias(f"new_{c}") for c in columns]), ["model_name", "feature_set"])
    return both.withColumns({f"delta_{c}": F.col(f"new_{c}") - F.col(f"old_{c}") for c in columns})


def board_changes(compared: DataFrame, column: str = "selection_score") -> DataFrame:
    """One row of a comparison: entries that met, improved, worsened and stayed, each metric's median change, and whether the
    new board is better: its median change is above zero and more entries improved than worsened."""
    delta = F.col(f"delta_{column}")
    medians = [F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in compared.columns if c.startswith("delta_")]
    out = compared.agg(F.count("*").alias("matched_count"), F.count_if(delta > 0).alias("improved_count"), F.count_if(delta < 0).alias("worsened_count"), F.count_if(delta == 0).alias("tie_count"), *medians)
    better = (F.col(f"median_delta_{column}") > 0) & (F.col("improved_count") > F.col("worsened_count"))
    return out.withColumn("new_board_better", F.coalesce(better, F.lit(False)))
