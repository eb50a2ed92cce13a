"""Which rows may be anchors: episode eligibility and the research universe, with diagnostics.

All metrics are row windows by ticker, those of many rows by `sliding.py`; a metric without all its rows is null, and a null metric
fails its rule.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import canonical_exchange, common_equity, ratio
from ledgerline.operators.features import by_day
from ledgerline.operators.sliding import Sliding, add_sliding

TYPE_COLUMNS = ("type", "security_type", "asset_type", "eodhd_type")


@dataclass(frozen=True)
class Eligibility:
    """Thresholds of an eligible episode; an empty tuple of exchanges allows all."""

    enabled: bool = True
    min_history: int = 60
    valid_rows: int = 55
    valid_lookback: int = 60
    min_avg_dollar_volume: float = 100_000.0
    dollar_lookback: int = 60
    min_price: float = 1.0
    exchanges: tuple[str, ...] = ("NYSE", "NASDAQ", "AMEX", "BATS")

    def __post_init__(self):
        if min(self.min_history, self.valid_lookback, self.dollar_lookback) < 1 or self.valid_rows > self.valid_lookback:
            raise ValueError("lookbacks must be positive, and no more valid rows asked for than looked at")


@dataclass(frozen=True)
class Research:
    """Thresholds of the research universe."""

    enabled: bool = True
    common_only: bool = True
    exchanges: tuple[str, ...] = ("NYSE", "NASDAQ", "AMEX")
    min_price: float = 10.0
    min_history: int = 252
    short: int = 20
    long: int = 60
    min_median_short: float = 10_000_000.0
    min_median_long: float = 10_000_000.0
    max_zero_ratio: float = 0.02
    min_current_ratio: float = 0.20
    trend: int = 252
    half_year: int = 126
    sma_short: int = 50
    sma_long: int = 200
    min_half_year_return: float = -0.15
    max_drawdown: float = 0.35
    above_sma: bool = True
    sma_rising: bool = True
    spikes: bool = True
    spike_rows: int = 60
    max_abs_return: float = 0.25
    max_true_range: float = 0.25

    def __post_init__(self):
        if min(self.min_history, self.short, self.long, self.trend, self.half_year, self.sma_short, self.sma_long, self.spike_rows) < 1:
            raise ValueError("lookbacks must be positive")


#: The two presets: the conservative universe, and the one for momentum.
CONSERVATIVE = Research()
MOMENTUM = Research(min_current_ratio=0.5, min_half_year_return=0.05, max_drawdown=0.60, above_sma=False, sma_rising=False, spikes=False)


def _type_ok(panel: DataFrame) -> Column:
    return common_equity(*[F.col(c) for c in TYPE_COLUMNS if c in panel.columns])


def _exchange_ok(panel: DataFrame, allowed: tuple[str, ...]) -> Column:
    if not allowed:
        return F.lit(True)
    return canonical_exchange(F.col("exchange")).isin(*allowed) if "exchange" in panel.columns else F.lit(False)


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def add_eligibility(panel: DataFrame, rules: Eligibility = Eligibility(), benchmark: str = "SPY") -> DataFrame:
    """Adds window_row_count, two metrics, six rules and episode_eligible."""
    rn = panel.withColumn("window_row_count", F.row_number().over(by_day()))
    names = ["common_equity", "history", "valid_ohlcv", "liquidity", "price", "exchange"]
    if not rules.enabled:
        return rn.withColumns({f"eligibility_{n}_ok": F.lit(True) for n in names} | {"eligibility_valid_ohlcv_rows": F.lit(None).cast("double"), "eligibility_avg_dollar_volume": F.lit(None).cast("double"), "episode_eligible": F.lit(True)})
    open_, high, low, close, volume, dollars = (F.col(c) for c in ("open", "high", "low", "close", "volume", "dollar_volume"))
    valid = _holds((open_ > 0) & (high > 0) & (low > 0) & (close > 0) & (high >= low) & (volume >= 0) & (dollars >= 0))
    out = add_sliding(rn, {"eligibility_valid_ohlcv_rows": Sliding("sum", valid.cast("double"), rules.valid_lookback), "eligibility_avg_dollar_volume": Sliding("avg", dollars, rules.dollar_lookback)})
    out = out.withColumns(
        {
            "eligibility_common_equity_ok": _type_ok(panel),
            "eligibility_history_ok": F.col("window_row_count") >= rules.min_history,
            "eligibility_valid_ohlcv_ok": F.coalesce("eligibility_valid_ohlcv_rows", F.lit(0.0)) >= rules.valid_rows,
            "eligibility_liquidity_ok": _holds(F.col("eligibility_avg_dollar_volume") >= rules.min_avg_dollar_volume),
            "eligibility_price_ok": _holds(close >= rules.min_price),
            "eligibility_exchange_ok": _exchange_ok(panel, rules.exchanges),
        }
    )
    all_ok = F.col("ticker") != benchmark.upper()
    for n in names:
        all_ok = all_ok & F.col(f"eligibility_{n}_ok")
    return out.withColumn("episode_eligible", all_ok)


def eligibility_summary(eligible: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """One row: tickers, eligible tickers and rows, and eligible tickers on the latest date."""
    rows = eligible.filter(F.col("ticker") != benchmark.upper())
    latest = rows.agg(F.max("date")).scalar()
    ticker_if = lambda c: F.countDistinct(F.when(c, F.col("ticker")))
    return rows.withColumn("latest_date", latest).agg(
        F.countDistinct("ticker").alias("total_ticker_count"),
        ticker_if(F.col("episode_eligible")).alias("eligible_ticker_count"),
        F.count_if("episode_eligible").alias("eligible_episode_rows"),
        F.max("latest_date").alias("latest_date"),
        ticker_if(F.col("episode_eligible") & (F.col("date") == F.col("latest_date"))).alias("latest_eligible_ticker_count"),
    )


def _unless_empty(panel: DataFrame, column: str, other: Column) -> Column:
    """The panel's column, or the other where the panel has none or only nulls in it; told by one value of it."""
    if column not in panel.columns:
        return other
    filled = panel.filter(F.col(column).isNotNull()).select(F.lit(True).alias("some")).limit(1).agg(F.max("some").alias("some")).scalar()
    return F.when(filled, F.col(column)).otherwise(other)


def research_metrics(panel: DataFrame, rules: Research = CONSERVATIVE, keep: Iterable[str] | None = None) -> DataFrame:
    """Adds history and metrics. `keep` names the panel's columns that stay, all by default; what nobody reads is dear to keep."""
    close, high, low, volume, dollars = (F.col(c) for c in ("close", "high", "low", "volume", "dollar_volume"))
    empty = ~_holds((volume > 0) & (dollars > 0))
    ret = _unless_empty(panel, "return_1d", ratio(close, F.lag("close").over(by_day())) - 1)
    spread = _unless_empty(panel, "true_range_pct", ratio(F.abs(high - low), close))
    out = panel.withColumns(
        {
            "research_history_days": F.row_number().over(by_day()),
            "research_return_6m": ratio(close, F.lag("close", rules.half_year).over(by_day())) - 1,
        }
    )
    kept = panel.columns if keep is None else list(keep)
    out = add_sliding(
        out,
        {
            "research_median_dollar_volume_20d": Sliding("median", dollars, rules.short),
            "research_median_dollar_volume_60d": Sliding("median", dollars, rules.long),
            "research_zero_volume_day_ratio_60d": Sliding("avg", empty.cast("double"), rules.long),
            "_highest": Sliding("max", F.coalesce(high, close), rules.trend),
            "_sma_short": Sliding("avg", close, rules.sma_short),
            "_sma_long": Sliding("avg", close, rules.sma_long),
            "research_max_abs_return_60d": Sliding("max", F.abs(ret), rules.spike_rows),
            "research_max_true_range_pct_60d": Sliding("max", spread, rules.spike_rows),
        },
        [*kept, "close", "dollar_volume", "research_history_days", "research_return_6m"],
    )
    return out.withColumns(
        {
            "research_drawdown_from_252d_high": 1 - ratio(close, F.col("_highest")),
            "research_close": close,
            "research_current_dollar_volume": dollars,
            "research_current_dollar_volume_vs_median20": ratio(dollars, F.col("research_median_dollar_volume_20d")),
            "research_close_to_sma200": ratio(close, F.col("_sma_long")),
            "research_sma50_to_sma200": ratio(F.col("_sma_short"), F.col("_sma_long")),
        }
    ).drop("_highest", "_sma_short", "_sma_long", *({"close", "dollar_volume"} - set(kept)))


def add_listing(listed: DataFrame, rules: Research = CONSERVATIVE) -> DataFrame:
    """Adds whether type and exchange pass. The universe adds it to its panel, row by row, unless it is there: a table of
    a row a ticker can have it before it is joined."""
    return listed.withColumns({"_type_ok": _type_ok(listed) if rules.common_only else F.lit(True), "_exchange_ok": _exchange_ok(listed, rules.exchanges)})


def _judged(panel: DataFrame, rules: Research, benchmark: str, keep: Iterable[str] | None) -> tuple[DataFrame, list[tuple[str, str, Column]]]:
    """The metrics and `_other` (not the benchmark), and what is checked: rule, reason code, condition."""
    c = F.col
    if not {"_type_ok", "_exchange_ok"} <= set(panel.columns):
        panel = add_listing(panel, rules)
    kept = panel.columns if keep is None else keep
    out = research_metrics(panel.withColumn("_other", c("ticker") != benchmark.upper()), rules, [*kept, "_other", "_type_ok", "_exchange_ok"])
    # The rules' groups and reason codes, in the order in which they are told.
    return out, [
        ("common_equity", "INVALID_SECURITY_TYPE", c("_type_ok")),
        ("exchange", "UNSUPPORTED_EXCHANGE", c("_exchange_ok")),
        ("history", "INSUFFICIENT_HISTORY", c("research_history_days") >= rules.min_history),
        ("price", "LOW_PRICE", c("research_close") >= rules.min_price),
        ("liquidity", "LOW_MEDIAN_DOLLAR_VOLUME_20D", c("research_median_dollar_volume_20d") >= rules.min_median_short),
        ("liquidity", "LOW_MEDIAN_DOLLAR_VOLUME_60D", c("research_median_dollar_volume_60d") >= rules.min_median_long),
        ("liquidity", "ZERO_VOLUME_DAYS", c("research_zero_volume_day_ratio_60d") <= rules.max_zero_ratio),
        ("liquidity", "CURRENT_DOLLAR_VOLUME_TOO_LOW", c("research_current_dollar_volume_vs_median20") >= rules.min_current_ratio),
        ("trend", "POOR_6M_TREND", c("research_return_6m") >= rules.min_half_year_return),
        ("trend", "EXCESSIVE_52W_DRAWDOWN", c("research_drawdown_from_252d_high") <= rules.max_drawdown),
        ("trend", "BELOW_200DMA", (c("research_close_to_sma200") >= 1.0) if rules.above_sma else F.lit(True)),
        ("trend", "50DMA_BELOW_200DMA", (c("research_sma50_to_sma200") >= 1.0) if rules.sma_rising else F.lit(True)),
        ("path_quality", "SPIKE_ABS_RETURN", (c("research_max_abs_return_60d") <= rules.max_abs_return) if rules.spikes else F.lit(True)),
        ("path_quality", "SPIKE_TRUE_RANGE", (c("research_max_true_range_pct_60d") <= rules.max_true_range) if rules.spikes else F.lit(True)),
    ]


def add_research_universe(panel: DataFrame, rules: Research = CONSERVATIVE, benchmark: str = "SPY", keep: Iterable[str] | None = None) -> DataFrame:
    """Adds the metrics, seven rules, research_universe_ok, and the reasons of rejection in fixed order, piped.

    The benchmark fails without a reason. Disabled rules pass all, but for type and exchange, which are still told.
    `keep` names the panel's columns that stay, all by default; the rules need none of them.
    """
    out, checks = _judged(panel, rules, benchmark, keep)
    c = F.col
    told = checks if rules.enabled else []
    rules_ok: dict[str, Column] = {}
    for name, _, ok in checks:
        ok = _holds(ok) if rules.enabled or name in ("common_equity", "exchange") else F.lit(True)
        rules_ok[f"research_{name}_ok"] = rules_ok[f"research_{name}_ok"] & ok if f"research_{name}_ok" in rules_ok else ok
    other = c("_other")
    reasons = F.array_compact(F.array(*[F.when(other & ~_holds(ok), F.lit(f"REJECTED_{code}")) for _, code, ok in told])) if told else F.array().cast("array<string>")
    everything = other if rules.enabled else F.lit(True)
    if rules.enabled:
        for name in rules_ok:
            everything = everything & c(name)
    out = out.withColumns(rules_ok).withColumn("_reasons", reasons)
    return out.withColumns(
        {"research_universe_ok": everything, "research_primary_rejection_reason": F.coalesce(F.try_element_at("_reasons", F.lit(1)), F.lit("")), "research_rejection_reasons": F.concat_ws("|", "_reasons")}
    ).drop("_reasons", "_other", "_type_ok", "_exchange_ok")


RULES = ["common_equity", "exchange", "history", "price", "liquidity", "trend", "path_quality"]


def rule_counts(universe: DataFrame) -> DataFrame:
    """rule, passed, failed: how many rows pass each rule and all of them. One pass."""
    names = [*(f"research_{n}_ok" for n in RULES), "research_universe_ok"]
    sums = universe.agg(*[F.count_if(n).alias(n) for n in names], F.count("*").alias("_all"))
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("passed"), (F.col("_all") - F.col(n)).alias("failed")) for n in names])
    return sums.select(F.explode(pairs).alias("x")).select("x.*")


def reason_histogram(panel: DataFrame, rules: Research = CONSERVATIVE, benchmark: str = "SPY") -> DataFrame:
    """reason, rows: how often add_research_universe gives each reason. Conditions are counted in one pass; no row gets a text."""
    out, checks = _judged(panel, rules, benchmark, ())
    told = checks if rules.enabled else []
    counts = [F.count_if(F.col("_other") & ~_holds(ok)).alias(code) for _, code, ok in told]
    pairs = [F.struct(F.lit(f"REJECTED_{code}").alias("reason"), F.col(code).alias("rows")) for _, code, _ in told]
    every = F.array(*pairs) if pairs else F.array().cast("array<struct<reason:string,rows:bigint>>")
    return out.agg(F.count("*").alias("_all"), *counts).select(F.explode(every).alias("x")).select("x.*").filter("rows > 0")


def attach_diagnostics(signals: DataFrame, universe: DataFrame, date: str = "anchor_date") -> DataFrame:
    """The universe's flags and reasons for each signal's ticker and date; unknown ones fail with an empty reason."""
    cols = [*(f"research_{n}_ok" for n in RULES), "research_universe_ok"]
    look = universe.select("ticker", F.col("date").alias(date), *cols, "research_primary_rejection_reason", "research_rejection_reasons")
    out = signals.join(look, ["ticker", date], "left")
    texts = ("research_primary_rejection_reason", "research_rejection_reasons")
    return out.withColumns({c: _holds(F.col(c)) for c in cols} | {c: F.coalesce(c, F.lit("")) for c in texts})
