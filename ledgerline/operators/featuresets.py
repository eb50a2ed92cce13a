"""Feature sets: which columns a named set has, the check of model inputs, and one builder for all of them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ledgerline.operators.cross_section import PANEL, SECTOR
from ledgerline.operators.enrich import merge_context
from ledgerline.operators.features import anchored_windows, cells, window_summaries
from ledgerline.operators.sliding import dealt

#: The features of each family.
MOVES = ["log_return_1d", "gap_pct", "intraday_return", "hl_range_pct", "close_location", "true_range_pct"]
TRENDS = ["rolling_return_5d", "rolling_return_20d", "rolling_return_60d", "rolling_vol_20d", "rolling_vol_60d", "price_vs_sma_20d", "price_vs_sma_60d"]
MOMENTA = ["momentum_20d", "momentum_60d"]
VOLUMES = ["volume_ratio_20d", "dollar_volume_ratio_5d", "volume_zscore_20d"]
RELATIVES = [f"stock_vs_{x}_return_{n}d" for n in (1, 5) for x in ("market", "sector")]
LOGS = [f"log1p_{x}" for x in ("volume", "dollar_volume", "rolling_avg_volume_20d", "rolling_avg_volume_60d", "rolling_avg_dollar_volume_20d", "rolling_avg_dollar_volume_60d")]
BASE = ["return_1d", *MOVES, *TRENDS, *MOMENTA, *VOLUMES, *RELATIVES, *LOGS]
CONTEXT = ["return_1d", *MOVES, *TRENDS, *MOMENTA, *VOLUMES]
COMPACT = [*MOVES, *TRENDS, *VOLUMES, *RELATIVES, "log1p_dollar_volume"]
COMPACT_CONTEXT = [
    "log_return_1d", "rolling_return_5d", "rolling_return_20d", "rolling_return_60d", "rolling_vol_20d", "rolling_vol_60d", "close_location", "true_range_pct",
    "price_vs_sma_20d", "price_vs_sma_60d", "volume_ratio_20d", "dollar_volume_ratio_5d", "volume_zscore_20d",
]
COMPACT_RELATIVE = [f"{x}__cs_z" for x in ("log1p_dollar_volume", *TRENDS, "volume_ratio_20d")]
COMPACT_SECTOR = [f"{x}__sector_cs_z" for x in ("log1p_dollar_volume", *TRENDS[1:5], "volume_ratio_20d")]
LEAN = [*MOVES, *TRENDS, *MOMENTA, *VOLUMES, *RELATIVES]
LEAN_RELATIVE = [f"{x}__{s}" for x in ("log1p_dollar_volume", "return_1d", *TRENDS, *MOMENTA, "volume_ratio_20d") for s in ("cs_z", "cs_pct")]
LEAN_SECTOR = [f"{x}__{s}" for x in ("log1p_dollar_volume", "return_1d", *TRENDS[1:5], *MOMENTA, "volume_ratio_20d") for s in ("sector_cs_z", "sector_cs_pct")]
FUNDAMENTAL = [f"fundamental_{x}" for x in (
    "revenue", "net_income", "gross_profit", "ebitda", "total_assets", "total_liabilities", "total_equity", "operating_cash_flow", "free_cash_flow", "shares_outstanding",
    "net_margin", "gross_margin", "roa", "debt_to_assets", "ocf_margin", "missing", "staleness_days",
)]
SENTIMENT = ["sentiment_count", "sentiment_normalized", "sentiment_missing", *[f"sentiment_{x}_{n}d" for x in ("count", "normalized_mean", "weighted") for n in (5, 20, 60)]]
#: Levels and identifiers that no model may take.
FORBIDDEN = ("open", "high", "low", "close", "volume", "dollar_volume", "prev_close", "sma_close_20d", "sma_close_60d", "rolling_avg_volume_20d", "rolling_avg_volume_60d", "rolling_avg_dollar_volume_20d", "rolling_avg_dollar_volume_60d", "adjustment_factor", "ticker", "date", "anchor_date")
SUFFIXES, PREFIXES = r"__(last|mean60|std60)$", r"^(stock|market_context|sector_context)_"


def tokens(name: str) -> set[str]:
    return set(name.removesuffix("_sequence").split("_"))


def numeric(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if isinstance(f.dataType, (NumericType, BooleanType))}


def stock_features(name: str, available: set[str]) -> list[str]:
    """The stock's own columns in a named set: those asked for that are there, in order."""
    parts = tokens(name)
    if "lean" in parts:
        wanted = [*LEAN, *LEAN_RELATIVE, *LEAN_SECTOR]
    elif "compact" in parts:
        wanted = [*COMPACT, *([*COMPACT_RELATIVE, *COMPACT_SECTOR] if "relative" in parts else [])]
    else:
        wanted = [*BASE, *([f"{c}__{s}" for cols, kinds in ((PANEL, ("cs_z", "cs_pct")), (SECTOR, ("sector_cs_z", "sector_cs_pct"))) for c in cols for s in kinds] if "relative" in parts else [])]
    wanted += SENTIMENT * ("sentiment" in parts) + FUNDAMENTAL * ("fundamentals" in parts)
    return [c for c in dict.fromkeys(wanted) if c in available]


def context_features(name: str, available: set[str]) -> list[str]:
    return [c for c in (COMPACT_CONTEXT if tokens(name) & {"compact", "lean"} else CONTEXT) if c in available]


def sequence_features(name: str, stock: set[str], context: set[str]) -> list[str]:
    """The columns of a sequence set, context ones prefixed, each context with its missing flag."""
    cols = stock_features(name, stock)
    for kind in ("market", "sector"):
        if kind in tokens(name):
            cols += [f"{kind}_context_{c}" for c in context_features(name, context)] + [f"{kind}_context_missing"]
    return list(dict.fromkeys(cols))


def check_inputs(columns: list[str]) -> None:
    """Raises if a column is a raw level or an identifier, whatever prefix and summary suffix it has."""
    bad = [c for c in columns if re.sub(PREFIXES, "", re.sub(SUFFIXES, "", c)) in FORBIDDEN]
    if bad:
        raise ValueError(f"not model inputs: {bad}")


def aligned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The model's columns; one that is absent is an error, not a zero."""
    absent = [c for c in columns if c not in rows.columns]
    if absent:
        raise ValueError(f"absent model inputs: {absent}")
    return rows.select(*columns)


def build(name: str, panel: DataFrame, context: DataFrame | None, anchors: DataFrame | None, benchmark: str, n: int = 60, stock: list[str] | None = None) -> DataFrame:
    """The named set for each anchor (ticker, date): last values, means and deviations over n rows, with contexts.

    The panel has sector_etf if the set has a sector context. Summaries are taken over the tickers of the anchors only,
    since a filter on other columns cannot be pushed below their windows. Without anchors each row of the panel is one, and
    nothing is shuffled after the windows. `stock` names the stock's columns that are made, all by default.
    """
    parts, cols = tokens(name), stock_features(name, numeric(panel))
    absent = [c for c in stock or [] if re.sub(SUFFIXES, "", c.removeprefix("stock_")) not in cols]
    if absent:
        raise ValueError(f"not in {name}: {absent}")
    if anchors is None:
        out = window_summaries(panel, cols, "stock_", n, stock, ["sector_etf"] * ("sector" in parts))
    else:
        chosen = panel.join(anchors.select("ticker").distinct(), "ticker", "left_semi")
        out = anchors.join(window_summaries(chosen, cols, "stock_", n, stock), ["ticker", "date"], "left")
    if parts & {"market", "sector"}:
        if context is None:
            raise ValueError(f"{name} needs a context")
        around = window_summaries(context, context_features(name, numeric(context)), "context_", n)
        if "market" in parts:
            out = merge_context(out, around, "market_context_", benchmark=benchmark)
        if "sector" in parts:
            if "sector_etf" not in out.columns:
                out = out.join(panel.select("ticker", "date", "sector_etf"), ["ticker", "date"], "left")
            out = merge_context(out, around, "sector_context_")
    check_inputs([c for c in out.columns if c.startswith(("stock_", "market_context_", "sector_context_"))])
    return out


def build_sequences(
    name: str, panel: DataFrame, context: DataFrame | None, anchors: DataFrame | list[str], benchmark: str, n: int = 60, codes: dict[str, DataFrame] | None = None,
    about: int | None = None, mark: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The anchors that have n rows up to theirs, with `window`, n arrays of floats in the order of sequence_features.

    A context's features are those of its dates: the benchmark's, and those of the row's sector_etf. Where a date has none of
    them, its missing flag is 1 and they are 0. codes: vocabularies by column of the anchors, which add <column>_code, 0 for
    unknown values. Only rows of the anchors' tickers are taken. Where each row of the panel is an anchor, `anchors` names those
    of its columns that stay beside the windows. mark: as in anchored_windows.

    A row that is an anchor is dealt by ticker with its own cells alone, to more tasks if there are many (`about`, or fewer);
    then those of the broadcast contexts, which are cells already, follow.
    """
    cols = sequence_features(name, numeric(panel), numeric(context) if context is not None else set())
    check_inputs(cols)
    kinds = [x for x in ("market", "sector") if x in tokens(name)]
    if kinds and context is None:
        raise ValueError(f"{name} needs a context")
    carried = anchors if isinstance(anchors, list) else []
    rows = panel if isinstance(anchors, list) else panel.join(anchors.select("ticker").distinct(), "ticker", "left_semi")
    own = stock_features(name, numeric(panel))
    rows = rows.select("ticker", "date", *dict.fromkeys([*carried, *["sector_etf"] * ("sector" in kinds)]), cells(own).alias("_own"))
    if isinstance(anchors, list):
        rows = rows.repartition("ticker") if about is None else dealt(rows, about, "ticker")
    parts = [F.col("_own")]
    for kind in kinds:
        features = context_features(name, numeric(context))
        missing = F.lit(True)
        for c in features:
            missing = missing & F.col(c).isNull()
        around = context.select("date", F.col("ticker").alias("sector_etf"), F.concat(cells(features), F.array(missing.cast("float"))).alias(f"_{kind}"))
        keys = ["date", "sector_etf"]
        if kind == "market":
            around, keys = around.filter(F.col("sector_etf") == benchmark).drop("sector_etf"), ["date"]
        rows = rows.join(F.broadcast(around), keys, "left")
        parts.append(F.coalesce(F.col(f"_{kind}"), F.array(*[F.lit(x).cast("float") for x in [*[0.0] * len(features), 1.0]])))
    every = F.concat(*parts)
    if isinstance(anchors, list):
        for column, known in (codes or {}).items():
            rows = encoded(rows, column, known.hint("broadcast"))
        carried = [*carried, *(f"{c}_code" for c in codes or {})]
        return anchored_windows(rows, None, every, n, carried, mark)
    for column, known in (codes or {}).items():
        anchors = encoded(anchors, column, known)
    return anchored_windows(rows, anchors, every, n, [c for c in anchors.columns if c not in ("ticker", "date")], mark)


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values in order with their codes from 1; 0 stands for unknown ones."""
    from pyspark.sql import Window

    return rows.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)))


def encoded(rows: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    return rows.join(codes, column, "left").withColumn(f"{column}_code", F.coalesce("code", F.lit(0))).drop("code")


def standardizer(rows: DataFrame, columns: list[str], also: dict[str, Column] | None = None) -> DataFrame:
    """feature, mean, scale: population deviations, 1 where they vanish; nulls do not count. One pass of partial sums.

    `also` names further aggregates of the rows, which that pass makes too; they stand beside each feature."""
    also = also or {}
    sums = rows.agg(*[e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))], *[x.alias(name) for name, x in also.items()])
    scale = lambda c: F.when(F.col(f"s_{c}") < 1e-12, 1.0).otherwise(F.col(f"s_{c}"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), scale(c).alias("scale")) for c in columns])
    return sums.select(F.explode(pairs).alias("x"), *also).select("x.*", *also)


#: A column's stored moments: how many values, their mean, and the squares of their distances from it summed up.
MOMENTS = "feature string, n long, mean double, squares double"


def moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, mean, squares of each column, by one pass of partial sums. Nulls do not count."""
    sums = rows.agg(*[e for c in columns for e in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), (F.var_pop(c) * F.count(c)).alias(f"q_{c}"))])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").cast("double").alias("mean"), F.col(f"q_{c}").alias("squares")) for c in columns])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def merged_moments(parts: DataFrame) -> DataFrame:
    """The moments of all parts' rows together, a row a feature: parts are taken two by two, smaller ones first.

    Each two are merged about their common mean, so nothing large is subtracted from something large. Parts without
    values change nothing.
    """
    known = F.filter(F.sort_array(F.collect_list(F.struct("n", "mean", "squares"))), lambda x: x["n"] > 0)
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("squares"))

    def two(a, b):
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        joined = F.struct(n.alias("n"), (a["mean"] + gap * (b["n"] / n)).alias("mean"), (a["squares"] + b["squares"] + gap * gap * (a["n"] * (b["n"] / n))).alias("squares"))
        return F.when(a["n"] == 0, b).otherwise(joined)

    return parts.groupBy("feature").agg(F.aggregate(known, nothing, two).alias("x")).select("feature", "x.*")


def scales(merged: DataFrame) -> DataFrame:
    """feature, mean, scale as standardizer gives them, of stored moments."""
    deviation = F.sqrt(F.col("squares") / F.nullif("n", F.lit(0)))
    return merged.select("feature", "mean", F.when(deviation < 1e-12, 1.0).otherwise(deviation).alias("scale"))


def add_moments(increment: DataFrame, columns: list[str], folder: str) -> None:
    """Keep an increment's moments beside those of the rows before it; rows already counted are not read again."""
    moments(increment, columns).coalesce(1).write.mode("append").parquet(folder)
