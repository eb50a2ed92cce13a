"""Per-ticker daily features with dense windows.

A dense window of n is made of the last n values that are not null, the current one included. All windows partition by
ticker; those of many values are in `sliding.py`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import ratio
from ledgerline.operators.sliding import Sliding, add_sliding


#: The columns that daily_features adds, numbers and flags.
DAILY = [
    "prev_close", "return_1d", "log_return_1d", "gap_pct", "intraday_return", "hl_range_pct", "close_location", "true_range_pct", "rolling_return_5d", "rolling_return_20d", "rolling_return_60d",
    "rolling_vol_20d", "rolling_vol_60d", "rolling_avg_volume_20d", "rolling_avg_volume_60d", "rolling_avg_dollar_volume_20d", "rolling_avg_dollar_volume_60d", "sma_close_20d", "sma_close_60d",
    "price_vs_sma_20d", "price_vs_sma_60d", "momentum_20d", "momentum_60d", "volume_ratio_20d", "dollar_volume_ratio_5d", "volume_zscore_20d",
]
DAILY_FLAGS = ["has_prev_close", "has_20d_history", "has_60d_history"]
#: Of which columns a feature is made after the windows.
MADE_OF = {
    **{f"rolling_return_{n}d": ["close", f"_back_{n}"] for n in (5, 20, 60)},
    **{f"momentum_{n}d": [f"rolling_return_{n}d"] for n in (20, 60)},
    **{f"sma_close_{n}d": [f"_sma_{n}", f"_sma_before_{n}"] for n in (20, 60)},
    **{f"price_vs_sma_{n}d": ["close", f"sma_close_{n}d"] for n in (20, 60)},
    **{f"has_{n}d_history": ["_n_close", "close"] for n in (20, 60)},
    "volume_ratio_20d": ["volume", "rolling_avg_volume_20d"],
    "dollar_volume_ratio_5d": ["dollar_volume", "_dollars_5"],
    "volume_zscore_20d": ["volume", "rolling_avg_volume_20d", "_volume_sd"],
    "has_prev_close": ["prev_close"],
}


def by_day():
    """A ticker's rows by date. Built on use, as it needs a session."""
    return Window.partitionBy("ticker").orderBy("date")


def dense_lag(name: str, k: int) -> Column:
    """The k-th value before this row that is not null."""
    return F.expr(f"lag(`{name}`, {k}) IGNORE NULLS OVER (PARTITION BY ticker ORDER BY date)")


def moves(bars: DataFrame) -> DataFrame:
    """Adds what a bar and the last close before it give: returns, gap, ranges."""
    prev, close, open_, high, low = (F.col(c) for c in ("prev_close", "close", "open", "high", "low"))
    with_prev = bars.withColumn("prev_close", dense_lag("close", 1)).withColumn("return_1d", ratio(close, prev) - 1)
    true_range = F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))
    return with_prev.withColumns(
        {
            "log_return_1d": F.when(1 + F.col("return_1d") > 0, F.log1p("return_1d")),
            "gap_pct": ratio(open_, prev) - 1,
            "intraday_return": ratio(close, open_) - 1,
            "hl_range_pct": ratio(high - low, close),
            "close_location": F.when(close != 0, ratio(close - low, high - low)),
            "true_range_pct": F.when(high.isNotNull() & low.isNotNull(), ratio(true_range, prev)),
        }
    )


def daily_features(bars: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """bars: ticker, date, open, high, low, close, volume, dollar_volume. Adds all daily features.

    rolling_return_{n}d compares with the close n-1 values before. A moving average of a day without a close is that
    of the n-1 closes before it. One shuffle by ticker; a row's features use no later row. `wanted` names the columns that
    are returned, the bars' own and features: only what these are made of goes through the windows.
    """
    given = [c for c in bars.columns if c not in {*DAILY, *DAILY_FLAGS}]
    returned = [*given, *DAILY, *DAILY_FLAGS] if wanted is None else wanted
    need, left = {"ticker", "date"}, list(returned)
    while left:
        c = left.pop()
        need.add(c)
        left += MADE_OF.get(c, [])
    needed = lambda new: {k: v for k, v in new.items() if k in need}
    out = moves(bars)
    out = out.withColumns({"_n_close": F.count("close").over(by_day().rowsBetween(Window.unboundedPreceding, 0))} | {f"_back_{n}": dense_lag("close", n - 1) for n in (5, 20, 60)})
    close, ret, vol, dollars = (F.col(c) for c in ("close", "return_1d", "volume", "dollar_volume"))
    dense = lambda kind, x, n, at_null=False: Sliding(kind, x, n, dense=True, at_null=at_null)
    sliding = (
        {f"rolling_vol_{n}d": dense("stddev", ret, n) for n in (20, 60)}
        | {f"rolling_avg_volume_{n}d": dense("avg", vol, n) for n in (20, 60)}
        | {f"rolling_avg_dollar_volume_{n}d": dense("avg", dollars, n) for n in (20, 60)}
        | {f"_sma_{n}": dense("avg", close, n) for n in (20, 60)}
        | {f"_sma_before_{n}": dense("avg", close, n - 1, at_null=True) for n in (20, 60)}
        | {"_dollars_5": dense("avg", dollars, 5), "_volume_sd": dense("stddev", vol, 20)}
    )
    out = add_sliding(out, needed(sliding), need)
    closes = {f"rolling_return_{n}d": ratio(close, F.col(f"_back_{n}")) - 1 for n in (5, 20, 60)} | {f"sma_close_{n}d": F.coalesce(f"_sma_{n}", f"_sma_before_{n}") for n in (20, 60)}
    before = F.col("_n_close") - F.col("close").isNotNull().cast("int")
    last = (
        {f"price_vs_sma_{n}d": F.when(F.col("close") != 0, ratio(F.col("close"), F.col(f"sma_close_{n}d")) - 1) for n in (20, 60)}
        | {f"momentum_{n}d": F.col(f"rolling_return_{n}d") for n in (20, 60)}
        | {
            "volume_ratio_20d": F.when(F.col("volume") != 0, ratio(F.col("volume"), F.col("rolling_avg_volume_20d"))),
            "dollar_volume_ratio_5d": F.when(F.col("dollar_volume") != 0, ratio(F.col("dollar_volume"), F.col("_dollars_5"))),
            "volume_zscore_20d": ratio(F.col("volume") - F.col("rolling_avg_volume_20d"), F.col("_volume_sd")),
            "has_prev_close": F.col("prev_close").isNotNull(),
            "has_20d_history": before >= 19,
            "has_60d_history": before >= 59,
        }
    )
    return out.withColumns(needed(closes)).withColumns(needed(last)).select(*returned)


def recent_rows(bars: DataFrame, since: Column, n: int = 60) -> DataFrame:
    """The rows from `since` on, and before it as many of each ticker as dense windows of n values at those rows can reach.

    Of closes, returns, volumes and dollar volumes alike, so daily_features gives the same from `since` on; a ticker that has
    fewer values of one of them keeps all its rows. Dealt by ticker, as the features are.
    """
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    before = F.expr("lead(close, 1) IGNORE NULLS OVER (PARTITION BY ticker ORDER BY date DESC)")
    old = bars.withColumn("_old", F.col("date") < since).withColumn("_return", ratio(F.col("close"), before))
    # A row goes when more than n values of each kind lie between it and `since`: the last of them has the close before it.
    later = [F.count(F.when(F.col("_old"), F.col(c))).over(back.rowsBetween(Window.unboundedPreceding, -1)) for c in ("close", "_return", "volume", "dollar_volume")]
    return old.withColumn("_later", F.least(*later)).filter(~F.col("_old") | (F.col("_later") <= n)).drop("_old", "_return", "_later")


def row_window(n: int):
    return by_day().rowsBetween(-(n - 1), 0)


def over_rows(aggregate, x: Column, n: int) -> Column:
    """The aggregate over the last n rows; null unless all n hold a value."""
    return F.when(F.count(x).over(row_window(n)) == n, aggregate(x).over(row_window(n)))


def add_if_absent(panel: DataFrame) -> DataFrame:
    """Adds the four range and volume features with row semantics, each only if the panel lacks it."""
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    prev = F.col("prev_close") if "prev_close" in panel.columns else F.lag("close").over(by_day())
    dollars, volume = F.col("dollar_volume"), F.col("volume")
    new = {
        "close_location": ratio(close - low, high - low),
        "true_range_pct": ratio(F.greatest(high - low, F.abs(high - prev), F.abs(low - prev)), prev),
        "dollar_volume_ratio_5d": ratio(dollars, over_rows(F.avg, dollars, 5)),
        "volume_zscore_20d": ratio(volume - over_rows(F.avg, volume, 20), over_rows(F.stddev_pop, volume, 20)),
    }
    return panel.withColumns({k: v for k, v in new.items() if k not in panel.columns})


def window_summaries(panel: DataFrame, features: list[str], prefix: str, n: int = 60, wanted: list[str] | None = None, carried: list[str] | None = None) -> DataFrame:
    """ticker, date, and of each feature its last value, mean and population deviation over n rows.

    Columns end in __last, __mean60 and __std60, whatever n is. `wanted` names those that are made, all by default; carried
    columns of the panel stay beside them.
    """
    names = {c: [x for x in (f"{prefix}{c}__{k}" for k in ("last", "mean60", "std60")) if wanted is None or x in wanted] for c in features}
    new = {}
    for c, made in names.items():
        new |= {x: Sliding("avg" if x.endswith("mean60") else "stddev", F.col(f"{prefix}{c}__last"), n) for x in made if not x.endswith("__last")}
    kept = ["ticker", "date", *(carried or [])]
    out = add_sliding(panel.select(*kept, *[F.col(c).alias(f"{prefix}{c}__last") for c, made in names.items() if made]), new)
    return out.select(*kept, *[x for made in names.values() for x in made])


def sequence_windows(panel: DataFrame, features: list[str], n: int, carried: list[str] | None = None) -> DataFrame:
    """ticker, date, window: the last n rows' features as an array of arrays, null as 0; rows with a whole window only.

    Carried columns of the panel stay beside them, so that no window is joined or shuffled.
    """
    row = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in features])
    return panel.withColumn("_rn", F.row_number().over(by_day())).withColumn("window", F.collect_list(row).over(row_window(n))).filter(F.col("_rn") >= n).select("ticker", "date", *(carried or []), "window")


def cells(features: list[str]) -> Column:
    """A row's features as an array of floats, null and NaN as 0."""
    zero = F.lit(0.0).cast("float")
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("float"), zero), zero) for c in features])


def anchored_windows(panel: DataFrame, anchors: DataFrame | None, features: list[str] | Column, n: int, carried: list[str] | None = None, mark: Callable[[Column], Column] | None = None) -> DataFrame:
    """ticker, date, window: for each anchor (ticker, date) with n rows up to it, these rows' features as n arrays of floats.

    Null and NaN are 0. A ticker has a date once. Its rows are cut into runs of n, and a window is the end of one run and the
    start of the next, so every row is held once, whatever the number of anchors, and only their windows are made.
    Anchors without a row or with fewer than n give none; repeated ones give one. With carried columns of the anchors each
    anchor gives its own row, with them; they travel with the rows, so that no window is joined, sorted or shuffled.

    Without anchors each row is one, and carried columns are the panel's own: rows that are dealt by ticker already are not
    shuffled. features: names, or the array itself. `mark` makes a value of a row's array, once a row; `marks` has those of a
    window's rows, so what is asked of every cell is not asked again in each of n windows.
    """
    each = panel.withColumn("_x", features if isinstance(features, Column) else cells(features)).select("ticker", "date", "_x", *(carried or [] if anchors is None else []))
    each = each.withColumn("_mark", mark(F.col("_x")) if mark else F.lit(None))
    if anchors is None:
        rows = each.withColumn("_wanted", F.array(F.struct(*carried) if carried else F.lit(True))).drop(*(carried or []))
    else:
        own = F.collect_list(F.struct(*carried)) if carried else F.collect_set(F.lit(True))
        rows = each.join(anchors.groupBy("ticker", "date").agg(own.alias("_wanted")), ["ticker", "date"], "left")
    numbered = rows.withColumn("_k", F.row_number().over(by_day()) - 1).withColumn("_run", F.floor(F.col("_k") / n))
    # Dealt by ticker as the numbers are: neither the runs nor those before them are shuffled again.
    runs = numbered.groupBy("ticker", "_run").agg(F.sort_array(F.collect_list(F.struct("_k", "date", "_wanted", "_x", *(["_mark"] if mark else [])))).alias("_own"))
    before = F.coalesce(F.lag("_own").over(Window.partitionBy("ticker").orderBy("_run")), F.slice("_own", 1, 0))
    both = runs.withColumn("_first", F.size(before)).withColumn("_both", F.concat(before, F.col("_own")))
    parts = {"_cells": "_x"} | ({"_marks": "_mark"} if mark else {})
    both = both.withColumns({name: F.col("_both")[x] for name, x in parts.items()}).drop("_both")
    whole = F.filter("_own", lambda x: x["_wanted"].isNotNull() & (x["_k"] >= n - 1))
    first = lambda x: (F.col("_first") + x["_k"] % n - n + 2).cast("int")
    places = F.flatten(F.transform(whole, lambda x: F.transform(x["_wanted"], lambda a: F.struct(x["date"].alias("date"), first(x).alias("first"), a.alias("anchor")))))
    out = both.select("ticker", *parts, F.explode(places).alias("_w"))
    last = [F.slice(name, F.col("_w.first"), n).alias(x) for name, x in zip(parts, ("window", "marks"))]
    return out.select("ticker", "_w.date", *[F.col("_w.anchor")[c].alias(c) for c in carried or []], *last)
