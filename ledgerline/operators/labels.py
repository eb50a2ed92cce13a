"""Forward targets, paths and labels. Only these look ahead of a row's date.

Windows and labels are computed on the full panel; eligibility and universe only mask which rows may be anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import ratio
from ledgerline.operators.features import by_day

ANYTIME, SUSTAINED, PATH = "anytime", "sustained", "path"
#: The path label's bounds and horizon.
LOSS, GAIN, PATH_HORIZON = -0.05, 0.05, 20


def _with_benchmark(panel: DataFrame, benchmark: DataFrame) -> DataFrame:
    # A row a date: broadcast, as by the size of what it is made from the whole panel would be shuffled by date and back.
    return panel.join(F.broadcast(benchmark.select("date", F.col("close").alias("_b"))), "date", "left")


def _excess(h: int) -> Column:
    return ratio(F.lead("close", h).over(by_day()), F.col("close")) - 1 - (ratio(F.lead("_b", h).over(by_day()), F.col("_b")) - 1)


def forward_targets(panel: DataFrame, benchmark: DataFrame, horizons: list[int], longest: int) -> DataFrame:
    """Adds target_{h}d, the return over h rows less the benchmark's over the same dates, future_date_{h}d, and whether the longest horizon is there."""
    out = _with_benchmark(panel, benchmark)
    new = {f"target_{h}d": _excess(h) for h in horizons} | {f"future_date_{h}d": F.lead("date", h).over(by_day()) for h in horizons}
    whole = Window.partitionBy("ticker")
    new |= {"has_all_future_horizons": F.row_number().over(by_day()) <= F.count(F.lit(1)).over(whole) - longest}
    return out.withColumns(new).drop("_b")


def path_label(path: Column, event: str, threshold: float = GAIN, low: float = LOSS, high: float = GAIN) -> Column:
    """The label of an array of forward returns.

    anytime: the highest exceeds the threshold; nulls are skipped and never give null. sustained: it does, and the last
    return and the mean of the last five are positive. path: any null gives null; else 0 if one is at `low` or less,
    2 if one is at `high` or more, else 1.
    """
    top = F.array_max(path)
    if event == ANYTIME:
        return F.coalesce(top > threshold, F.lit(False)).cast("double")
    if event == SUSTAINED:
        tail = F.filter(F.slice(path, F.greatest(F.size(path) - 4, F.lit(1)), 5), lambda x: x.isNotNull())
        mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(tail), F.lit(0))
        return F.coalesce((top > threshold) & (F.element_at(path, -1) > 0) & (mean > 0), F.lit(False)).cast("double")
    if event == PATH:
        return F.when(F.forall(path, lambda x: x.isNotNull()), F.when(F.array_min(path) <= low, 0.0).when(top >= high, 2.0).otherwise(1.0))
    raise ValueError(f"unknown event {event}")


def forward_path(panel: DataFrame, benchmark: DataFrame | None, horizon: int) -> DataFrame:
    """Adds path: the returns over 1 to horizon rows, less the benchmark's if there is one. Missing rows are null."""
    if benchmark is None:
        steps = [ratio(F.lead("close", k).over(by_day()), F.col("close")) - 1 for k in range(1, horizon + 1)]
        return panel.withColumn("path", F.array(*steps))
    return _with_benchmark(panel, benchmark).withColumn("path", F.array(*[_excess(k) for k in range(1, horizon + 1)])).drop("_b")


def labeled_targets(panel: DataFrame, benchmark: DataFrame, horizons: list[int], window: int, event: str, horizon: int, threshold: float = GAIN, low: float = LOSS, high: float = GAIN) -> DataFrame:
    """The panel with targets, label, and the masks candidate and final.

    A candidate has a full window and passes episode_eligible and research_universe_ok where the panel has them; a final
    row also has the full forward window, all targets and a label.
    """
    out = forward_targets(panel, benchmark, horizons, max([*horizons, horizon]))
    out = forward_path(out, None if event == PATH else benchmark, horizon).withColumn("label", path_label(F.col("path"), event, threshold, low, high)).drop("path")
    if "window_row_count" not in out.columns:
        out = out.withColumn("window_row_count", F.row_number().over(by_day()))
    mask = F.col("window_row_count") >= window
    for c in ("episode_eligible", "research_universe_ok"):
        if c in out.columns:
            mask = mask & F.coalesce(c, F.lit(False))
    complete = F.lit(True)
    for h in horizons:
        complete = complete & F.col(f"target_{h}d").isNotNull()
    return out.withColumns({"candidate": mask, "targets_complete": complete}).withColumn("final", F.col("candidate") & F.col("has_all_future_horizons") & F.col("targets_complete") & F.col("label").isNotNull())


def labeling_summary(labeled: DataFrame, window: int) -> DataFrame:
    """One row of counts: candidates, rows that only the universe excludes, unlabelled by cause, labelled, by class."""
    has, full, label = F.col("candidate"), F.col("has_all_future_horizons"), F.col("label").isNotNull()
    eligible = F.col("window_row_count") >= window
    if "episode_eligible" in labeled.columns:
        eligible = eligible & F.coalesce("episode_eligible", F.lit(False))
    outside = ~F.coalesce("research_universe_ok", F.lit(False)) if "research_universe_ok" in labeled.columns else F.lit(False)
    return labeled.agg(
        F.count_if(has).alias("candidate_rows"),
        F.count_if(eligible & outside).alias("universe_excluded_rows"),
        F.count_if(has & ~full).alias("missing_forward_rows"),
        F.count_if(has & full & ~label).alias("invalid_price_rows"),
        F.count_if(has & full & label & ~F.col("targets_complete")).alias("missing_target_rows"),
        F.count_if("final").alias("labeled_rows"),
        *[F.count_if(F.col("final") & (F.col("label") == k)).alias(f"class_{k}_rows") for k in range(3)],
    )


def episode_index(panel: DataFrame, benchmark: DataFrame, window: int, horizon: int, benchmark_ticker: str = "SPY") -> DataFrame:
    """An episode per anchor with `window` rows up to it and `horizon` after it, where the benchmark has both dates."""
    rows = panel.filter(F.col("ticker") != benchmark_ticker).withColumns(
        {
            "_rn": F.row_number().over(by_day()),
            "window_start_date": F.lag("date", window - 1).over(by_day()),
            "_future": F.lead("close", horizon).over(by_day()),
            "_future_date": F.lead("date", horizon).over(by_day()),
        }
    )
    marks = benchmark.select(F.col("date").alias("_d"), F.col("close").alias("_c")).filter(F.col("_c").isNotNull())
    rows = rows.filter((F.col("_rn") >= window) & (F.col("close") != 0) & F.col("_future").isNotNull())
    met = rows.join(marks.select(F.col("_d").alias("date"), F.col("_c").alias("_at")), "date").join(marks.select(F.col("_d").alias("_future_date"), F.col("_c").alias("_then")), "_future_date").filter("_at <> 0")
    gain = F.col("_future") / F.col("close") - 1
    return met.select(
        "ticker", F.col("date").alias("anchor_date"), "window_start_date", F.col("date").alias("window_end_date"), F.lit(horizon).alias("target_horizon_days"), gain.alias("target_return"),
        (gain - (F.col("_then") / F.col("_at") - 1)).alias("market_adjusted_target_return"), F.col("_future_date").alias("benchmark_future_date"), F.lit(window).alias("available_window_rows"),
    )
