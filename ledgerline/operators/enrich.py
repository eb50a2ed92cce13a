"""Point-in-time enrichment: backward as-of joins, fundamentals, sentiment and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import first_number, own_ticker, ratio
from ledgerline.operators.features import by_day, row_window
from ledgerline.operators.sliding import dealt

#: Fields of a vendor filing in order of preference.
AVAILABLE = ("filing_date", "filingDate", "filingDateTime", "acceptedDate", "accepted_date")
FIELDS = {
    "income": {"revenue": ("totalRevenue", "revenue", "Revenue"), "net_income": ("netIncome", "netIncomeApplicableToCommonShares"), "gross_profit": ("grossProfit",), "ebitda": ("ebitda", "EBITDA")},
    "balance": {
        "total_assets": ("totalAssets",),
        "total_liabilities": ("totalLiab", "totalLiabilities", "totalLiabilitiesNetMinorityInterest"),
        "total_equity": ("totalStockholderEquity", "totalEquityGrossMinorityInterest"),
        "shares_outstanding": ("commonStockSharesOutstanding", "commonStockShares"),
    },
    "cash": {"operating_cash_flow": ("totalCashFromOperatingActivities", "operatingCashflow", "operatingCashFlow"), "free_cash_flow": ("freeCashFlow", "FreeCashFlow")},
}
RATIOS = {
    "net_margin": ("net_income", "revenue"),
    "gross_margin": ("gross_profit", "revenue"),
    "roa": ("net_income", "total_assets"),
    "debt_to_assets": ("total_liabilities", "total_assets"),
    "ocf_margin": ("operating_cash_flow", "revenue"),
}
#: The fund that stands for each sector.
SECTOR_FUNDS = {
    "Communication Services": "XLC", "Consumer Discretionary": "XLY", "Consumer Staples": "XLP", "Energy": "XLE", "Financials": "XLF", "Health Care": "XLV",
    "Industrials": "XLI", "Information Technology": "XLK", "Materials": "XLB", "Real Estate": "XLRE", "Utilities": "XLU",
}
STATEMENTS = {"income": ("Income_Statement", "IncomeStatement"), "balance": ("Balance_Sheet", "BalanceSheet"), "cash": ("Cash_Flow", "CashFlow")}
PAYLOAD = "struct<Financials: map<string, map<string, map<string, map<string, string>>>>>"


def as_of(left: DataFrame, right: DataFrame, key: str, on: str, available: str, ties: list[str], about: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its key that was available by then; all left rows stay.

    Of right rows available on one day the one with the largest `ties` counts. A matched row's own nulls stay null:
    right rows travel as a struct. One union, one shuffle by key and one sort, in which the rows stay for windows by key; left
    columns that are not used later are not shuffled. `about`: how many rows there are, or more; with it many are dealt to
    more tasks.
    """
    fields = [c for c in right.columns if c != key]
    carried = F.struct(*[F.col(c) for c in fields])
    kind = right.select(carried.alias("r")).schema["r"].dataType
    # Both sides share the left's key and time; one of another type goes beside it.
    by, when = (a if left.schema[a].dataType == right.schema[b].dataType else c for a, b, c in ((key, key, "_key"), (on, available, "_when")))
    rows = left.select(*left.columns, *[F.col(a).alias(c) for a, c in ((key, by), (on, when)) if a != c], F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_right"))
    shared = {by: F.col(key), when: F.col(available), "_side": F.lit(0), "_right": carried}
    known = right.filter(F.col(available).isNotNull()).select(*[shared.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    both = rows.unionByName(known)
    if about is not None:
        both = dealt(both, about, by)
    order = Window.partitionBy(by).orderBy(when, "_side", *[F.col(f"_right.{c}").asc_nulls_first() for c in ties]).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_right", F.last("_right", ignorenulls=True).over(order)).filter("_side = 1")
    return met.select(*left.columns, *[F.col(f"_right.{c}").alias(c) for c in fields])


def add_fundamentals(panel: DataFrame, filings: DataFrame, about: int | None = None) -> DataFrame:
    """Filings as of each date, whether there is none, and days since the one that counts. about: as in as_of."""
    met = as_of(panel, filings, "ticker", "date", "availability_date", ["source_period_end", "source_frequency"], about)
    missing = F.col("availability_date").isNull()
    return met.withColumn("fundamental_missing", missing.cast("double")).withColumn("fundamental_staleness_days", F.datediff("date", "availability_date")).drop("availability_date", "source_period_end", "source_frequency")


def parse_filings(payloads: DataFrame, latest_statement: bool = False) -> DataFrame:
    """payloads: symbol, payload (vendor JSON). One row per period and frequency with fields and ratios.

    Bad JSON gives no rows. A statement without an availability date is dropped. The row is available when its income
    statement is, else balance sheet, else cash flow; latest_statement takes the latest of them, which looks ahead at
    nothing.
    """
    parsed = payloads.select(F.upper("symbol").alias("symbol"), F.from_json("payload", PAYLOAD).alias("p"))
    parts = []
    for part, names in STATEMENTS.items():
        statement = F.coalesce(*[F.col("p.Financials")[n] for n in names])
        rows = parsed.select("symbol", F.explode(statement).alias("source_frequency", "section")).filter(F.col("source_frequency").isin("quarterly", "yearly")).select("symbol", "source_frequency", F.explode("section").alias("period", "f"))
        filled = lambda *keys: F.coalesce(*[F.nullif(F.col("f")[k], F.lit("")) for k in keys])
        rows = rows.withColumn("source_period_end", F.substring(F.coalesce(filled("date", "period_end", "periodEndDate"), F.col("period")), 1, 10)).withColumn("available", F.substring(filled(*AVAILABLE), 1, 10))
        parts.append(rows.filter(F.col("available").isNotNull()).select("symbol", "source_frequency", "source_period_end", F.lit(part).alias("part"), "available", "f"))
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    one = lambda part, what: F.max_by(F.when(F.col("part") == part, F.col(what)), F.when(F.col("part") == part, F.col("period_rank")))
    stacked = stacked.withColumn("period_rank", F.lit(1))
    wide = stacked.groupBy("symbol", "source_frequency", "source_period_end").agg(*[one(p, w).alias(f"{p}_{w}") for p in STATEMENTS for w in ("available", "f")])
    dates = [F.col(f"{p}_available") for p in STATEMENTS]
    out = wide.withColumn("availability_date", (F.greatest(*dates) if latest_statement else F.coalesce(*dates)).try_cast("date")).withColumn("source_period_end", F.col("source_period_end").try_cast("date"))
    fields = {f"fundamental_{n}": first_number(*[F.col(f"{p}_f")[a] for a in aliases]) for p, group in FIELDS.items() for n, aliases in group.items()}
    out = out.withColumns(fields)
    return out.select(
        own_ticker(F.col("symbol")).alias("ticker"), "availability_date", "source_period_end", "source_frequency", *fields,
        *[ratio(F.col(f"fundamental_{a}"), F.col(f"fundamental_{b}")).alias(f"fundamental_{n}") for n, (a, b) in RATIOS.items()],
    )


def parse_sentiment(payloads: DataFrame) -> DataFrame:
    """payload: a JSON map from symbol to entries of date, count and normalized. One row per symbol and date."""
    parsed = payloads.select(F.from_json("payload", "map<string, array<struct<date: string, count: string, normalized: string>>>").alias("p"))
    rows = parsed.select(F.explode("p").alias("symbol", "entries")).select("symbol", F.explode("entries").alias("e"))
    return rows.select(own_ticker(F.col("symbol")).alias("ticker"), F.substring("e.date", 1, 10).try_cast("date").alias("date"), first_number(F.col("e.count")).alias("sentiment_count_raw"), first_number(F.col("e.normalized")).alias("sentiment_normalized_raw")).filter(
        F.col("ticker").isNotNull() & F.col("date").isNotNull()
    )


def add_sentiment(panel: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Yesterday's row's sentiment, null as 0, and sums and means of it over up to 5, 20 and 60 rows.

    Sentiment of a date without a bar matches nothing.
    """
    met = panel.join(sentiment.select("ticker", "date", "sentiment_count_raw", "sentiment_normalized_raw"), ["ticker", "date"], "left")
    lag = lambda c: F.lag(c).over(by_day())
    out = met.withColumns(
        {
            "sentiment_count": F.coalesce(lag("sentiment_count_raw"), F.lit(0.0)),
            "sentiment_normalized": F.coalesce(lag("sentiment_normalized_raw"), F.lit(0.0)),
            "sentiment_missing": lag("sentiment_normalized_raw").isNull().cast("double"),
        }
    )
    weighted = F.col("sentiment_count") * F.col("sentiment_normalized")
    out = out.withColumns(
        {f"sentiment_count_{n}d": F.sum("sentiment_count").over(row_window(n)) for n in (5, 20, 60)}
        | {f"sentiment_normalized_mean_{n}d": F.avg("sentiment_normalized").over(row_window(n)) for n in (5, 20, 60)}
        | {f"sentiment_weighted_{n}d": F.sum(weighted).over(row_window(n)) for n in (5, 20, 60)}
    )
    return out.drop("sentiment_count_raw", "sentiment_normalized_raw")


def add_sector_funds(panel: DataFrame) -> DataFrame:
    """Adds sector_etf, the fund of the row's gics_sector; null for other sectors."""
    return panel.withColumn("sector_etf", F.create_map(*[F.lit(x) for pair in SECTOR_FUNDS.items() for x in pair])[F.trim("gics_sector")])


def add_relative_returns(panel: DataFrame, context: DataFrame, benchmark: str, sector_tickers: DataFrame | None = None) -> DataFrame:
    """stock_vs_market_ and stock_vs_sector_return_{1,5}d: a row's returns less the benchmark's and its sector's of the date.

    context: daily features of benchmark and sector tickers. sector_tickers maps gics_sector to sector_etf; without it
    the panel has sector_etf. The context, a row a fund and date, is broadcast: the panel's rows stay where they are.
    """
    rows = panel if sector_tickers is None else panel.join(sector_tickers, "gics_sector", "left")
    ours = context.select(F.col("ticker").alias("_t"), "date", F.col("return_1d").alias("_r1"), F.col("rolling_return_5d").alias("_r5"))
    market = ours.filter(F.col("_t") == benchmark).select("date", F.col("_r1").alias("_m1"), F.col("_r5").alias("_m5"))
    out = rows.join(F.broadcast(market), "date", "left").join(F.broadcast(ours.withColumnRenamed("_t", "sector_etf")), ["date", "sector_etf"], "left")
    names = {"return_1d": ("_m1", "_r1", "return_1d"), "return_5d": ("_m5", "_r5", "rolling_return_5d")}
    new = {f"stock_vs_{kind}_{n}": F.col(own) - F.col(other) for n, (m, s, own) in names.items() for kind, other in (("market", m), ("sector", s))}
    return out.withColumns(new).drop("_m1", "_m5", "_r1", "_r5")


def merge_context(base: DataFrame, summaries: DataFrame, prefix: str, benchmark: str | None = None, by: str = "sector_etf") -> DataFrame:
    """The context's summaries of the date (and of the row's `by` ticker, without a benchmark), prefixed, and <prefix>context_missing.

    The summaries, a row a context ticker and date, are broadcast: the base's rows stay where they are.
    """
    names = {c: f"{prefix}{c.removeprefix('context_')}" for c in summaries.columns if c not in ("ticker", "date")}
    renamed = summaries.select("ticker", "date", *[F.col(c).alias(n) for c, n in names.items()])
    if benchmark is not None:
        out = base.join(F.broadcast(renamed.filter(F.col("ticker") == benchmark).drop("ticker")), "date", "left")
    else:
        out = base.join(F.broadcast(renamed.withColumnRenamed("ticker", by)), ["date", by], "left")
    missing = F.lit(True)
    for n in names.values():
        missing = missing & F.col(n).isNull()
    return out.withColumn(f"{prefix}context_missing", missing.cast("double"))
