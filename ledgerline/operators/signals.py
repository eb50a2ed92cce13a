"""Ranked signals, position review and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import argmax, business_days_held, clipped_probabilities, rank_bucket

#: Columns that a position ledger must have, statuses of closed ones, and the order of actions in reports.
LEDGER = ("ticker", "entry_date", "entry_price", "shares", "current_status")
CLOSED = ("CLOSED", "SOLD")
ACTIONS = {"ENTRY CANDIDATE": 0, "WATCHLIST": 1, "IGNORE": 2}


def prediction_frame(rows: DataFrame, classes: int) -> DataFrame:
    """Adds pred_prob_<i>, pred_class, pred_score (last class less first) and pred_positive from `probabilities`."""
    p = clipped_probabilities(F.col("probabilities"))
    out = rows.withColumn("_p", p)
    new = {f"pred_prob_{i}": F.element_at("_p", i + 1) for i in range(classes)}
    new |= {"pred_class": argmax(F.col("_p")), "pred_score": F.element_at("_p", classes) - F.element_at("_p", 1)}
    return out.withColumns(new).withColumn("pred_positive", F.col("pred_class") == classes - 1).drop("_p")


def implied_close(rows: DataFrame) -> DataFrame:
    """Adds the close that a predicted excess return and the benchmark's return imply."""
    return rows.withColumn("implied_close", F.col("anchor_close") * (1 + F.col("prediction") + F.coalesce("benchmark_return", F.lit(0.0))))


def rank_models(predictions: DataFrame) -> DataFrame:
    """Adds each prediction's rank, percentile and top flags within its model and feature set; ties by ticker."""
    key = F.concat_ws("::", "model_name", "feature_set")
    order = Window.partitionBy("model_key").orderBy(F.desc_nulls_last("prediction_score"), "ticker", "anchor_date")
    out = predictions.withColumn("model_key", key).withColumns({"model_rank": F.when(F.col("prediction_score").isNotNull(), F.row_number().over(order)), "_n": F.count("prediction_score").over(Window.partitionBy("model_key"))})
    out = out.withColumn("model_percentile", 100.0 * F.col("model_rank") / F.col("_n")).drop("_n")
    return out.withColumns({"model_top5": F.coalesce(F.col("model_percentile") <= 5, F.lit(False)), "model_top10": F.coalesce(F.col("model_percentile") <= 10, F.lit(False))})


def ranked_signals(predictions: DataFrame, run_date: str, entry: float = 5.0, watch: float = 10.0, agree: int = 2) -> DataFrame:
    """One row per ticker and date: the ensemble over all models, its rank, bucket, agreement, action and reason.

    The final ranking numbers one row per ticker scored on a day, by the score to twelve digits; ties by ticker.
    """
    one = rank_models(predictions).groupBy("ticker", "anchor_date").agg(
        F.max("anchor_close").alias("current_price"),
        F.avg("prediction_score").alias("ensemble_score"),
        F.countDistinct("model_key").alias("model_count"),
        F.count_if("model_top5").alias("top_5pct_model_count"),
        F.count_if("model_top10").alias("top_decile_model_count"),
        F.min("model_percentile").alias("best_model_percentile"),
        F.max("prediction_score").alias("best_model_score"),
    )
    order = Window.orderBy(F.desc(F.round("ensemble_score", 12)), F.desc("top_decile_model_count"), F.desc("best_model_score"), "ticker", "anchor_date")
    out = one.withColumn("ensemble_rank", F.row_number().over(order)).withColumn("ensemble_percentile", 100.0 * F.col("ensemble_rank") / F.count(F.lit(1)).over(Window.partitionBy()))
    pct, top5, top10 = F.col("ensemble_percentile"), F.col("top_5pct_model_count"), F.col("top_decile_model_count")
    # The texts of strengths, actions and reasons, and the bounds that they stand for.
    share = F.concat(top10.cast("string"), F.lit("/"), F.col("model_count").cast("string"))
    strength = F.when((top5 >= 2) | (pct <= 3), "VERY STRONG").when(top10 >= 2, "STRONG").when((top10 == 1) | (pct <= 10), "WEAK").otherwise("NONE")
    action = F.when((pct <= entry) & (top10 >= agree), "ENTRY CANDIDATE").when(pct <= watch, "WATCHLIST").otherwise("IGNORE")
    # format_number rounds the double's exact value, as printf does; format_string its shortest digits.
    reason = (
        F.when(action == "ENTRY CANDIDATE", F.concat(F.lit("Top "), F.format_number(pct, 2), F.lit("% with "), share, F.lit(" models in top decile")))
        .when((action == "WATCHLIST") & (top10 >= 2), F.concat(F.lit("Top decile with "), share, F.lit(" model agreement")))
        .when(action == "WATCHLIST", "Top decile but weak model agreement")
        .otherwise("Below top decile")
    )
    return out.select(
        F.lit(run_date).alias("run_date"), F.col("anchor_date").alias("prediction_date"), "ticker", rank_bucket(pct).alias("rank_bucket"),
        F.concat(strength, F.lit(" ("), share, F.lit(" top-decile)")).alias("agreement_status"), action.alias("suggested_action"), reason.alias("reason"), "current_price", "ensemble_score",
        "ensemble_rank", "ensemble_percentile", "model_count", "top_decile_model_count", "top_5pct_model_count", "best_model_score", "best_model_percentile",
    )


def review_positions(ledger: DataFrame, signals: DataFrame, run_date: str, target: float = 5.0, stop: float = -5.0, hold: int = 20, review: float = 20.0, strong: float = 30.0) -> DataFrame:
    """Open positions with their latest signal and what to do; the first rule that holds counts."""
    missing = [c for c in LEDGER if c not in ledger.columns]
    if missing:
        raise ValueError(f"the ledger lacks {missing}")
    own = lambda c, default: F.coalesce(F.col(c).try_cast("double"), F.lit(float(default))) if c in ledger.columns else F.lit(float(default))
    opened = ledger.filter(~F.upper(F.coalesce("current_status", F.lit(""))).isin(*CLOSED)).withColumn("ticker", F.upper("ticker"))
    look = signals.select("ticker", "prediction_date", "current_price", "rank_bucket", "agreement_status", "ensemble_percentile", "top_decile_model_count")
    out = opened.join(look, "ticker", "left").withColumns(
        {
            "run_date": F.lit(run_date),
            "current_return_pct": (F.col("current_price") / F.nullif(F.col("entry_price"), F.lit(0.0)) - 1) * 100,
            "days_held": business_days_held(F.col("entry_date").cast("date"), F.col("prediction_date").cast("date")),
            "target_profit_pct": own("target_profit_pct", target),
            "stop_loss_pct": own("stop_loss_pct", stop),
            "max_hold_days": own("max_hold_days", hold),
            "latest_rank_bucket": F.coalesce("rank_bucket", F.lit("NO_CURRENT_SIGNAL")),
            "agreement_status": F.coalesce("agreement_status", F.lit("NO_CURRENT_SIGNAL")),
        }
    )
    gain, days, pct, none = F.col("current_return_pct"), F.col("days_held"), F.col("ensemble_percentile"), F.col("top_decile_model_count") == 0
    # Actions and reasons of a review, in the order in which they count.
    rules = [
        (F.col("current_price").isNull(), "REVIEW", "No current prediction/price found for ticker"),
        (gain.isNull(), "REVIEW", "Current return could not be calculated"),
        (gain >= F.col("target_profit_pct"), "SELL - TARGET", "Current return reached target profit"),
        (gain <= F.col("stop_loss_pct"), "SELL - STOP", "Current return reached stop loss"),
        (days >= F.col("max_hold_days"), "SELL - TIME", "Max holding period reached"),
        (pct > strong, "STRONG REVIEW", "Latest rank fell below top 30%"),
        (pct > review, "REVIEW", "Latest rank fell below top 20%"),
        (none & (gain <= 0), "CONSIDER EXIT", "Model agreement disappeared and return is flat/negative"),
        (none & (days > 10), "CONSIDER EXIT", "Model agreement disappeared after more than 10 held days"),
    ]
    told = F.coalesce(*[F.when(ok, F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))) for ok, a, r in rules], F.struct(F.lit("HOLD").alias("action"), F.lit("No hard exit or review trigger").alias("reason")))
    notes = F.col("notes") if "notes" in ledger.columns else F.lit("")
    return out.withColumn("_told", told).select(
        "run_date", "ticker", "entry_date", "entry_price", "shares", "prediction_date", "current_price", "current_return_pct", "days_held", "target_profit_pct", "stop_loss_pct", "max_hold_days",
        "latest_rank_bucket", "agreement_status", F.col("_told.action").alias("review_action"), F.col("_told.reason").alias("reason"), notes.alias("notes"),
    )


def combine_sleeves(reports: dict[str, DataFrame]) -> DataFrame:
    """All sleeves' reports under one another, with the sleeve's name; columns that a report lacks are null."""
    named = [df.withColumn("sleeve", F.lit(name)) for name, df in reports.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def report_order(report: DataFrame) -> DataFrame:
    """Entries first, then the watchlist, then the rest, by percentile, sleeve and ticker."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("suggested_action")], F.lit(99))
    return report.orderBy(rank, "ensemble_percentile", *[c for c in ("sleeve", "ticker") if c in report.columns])
