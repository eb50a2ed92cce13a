"""Scans of vendor files with fixed schemas. NaN and infinities become null here, once."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from ledgerline.functions.scalars import canonical_exchange, epoch_ms_date, finite, lenient_bool, lenient_double, listed_exchange, other_security, own_ticker, ratio, vendor_symbol
from ledgerline.operators.features import DAILY, DAILY_FLAGS

BAR_NUMBERS = ("open", "high", "low", "close", "volume", "dollar_volume")
BAR_TEXT = StructType([StructField(c, StringType()) for c in ("date", "ticker", *BAR_NUMBERS[:5], "adjusted", "dollar_volume")])


def clean(df: DataFrame) -> DataFrame:
    """All NaN and infinities as null."""
    return df.withColumns({f.name: finite(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))})


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bar CSV: blank and N/A cells are null, adjusted is true, false or null."""
    rows = spark.read.csv(path, header=True, schema=BAR_TEXT)
    return rows.select(F.to_date("date").alias("date"), F.upper("ticker").alias("ticker"), *[lenient_double(F.col(c)).alias(c) for c in BAR_NUMBERS], lenient_bool(F.col("adjusted")).alias("adjusted"))


def read_processed(spark: SparkSession, path: str, numbers: list[str] = (*BAR_NUMBERS, *DAILY), flags: list[str] = DAILY_FLAGS, texts: list[str] = ("ticker", "gics_sector", "gics_sub_industry")) -> DataFrame:
    """A processed CSV by its header: the named columns with their types, by default those of bars and daily features;
    others are not read."""
    rows = spark.read.csv(path, header=True)
    here = set(rows.columns)
    return rows.select(
        F.to_date("date").alias("date"), *[F.col(c) for c in texts if c in here], *[lenient_double(F.col(c)).alias(c) for c in numbers if c in here], *[lenient_bool(F.col(c)).alias(c) for c in flags if c in here]
    )


def metadata(rows: DataFrame, order: str) -> DataFrame:
    """One row a ticker: the last by `order`; ticker from symbol, ticker or code, sector with fallbacks, else Unknown."""
    text = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in names if c in rows.columns], F.lit(None))
    named = rows.withColumn("_t", own_ticker(text("symbol", "ticker", "code"))).filter(F.col("_t").isNotNull())
    last = named.withColumn("_rn", F.row_number().over(Window.partitionBy("_t").orderBy(F.desc(order)))).filter("_rn = 1")
    return last.select(F.col("_t").alias("ticker"), F.coalesce(text("gics_sector", "sector"), F.lit("Unknown")).alias("gics_sector"), F.coalesce(text("gics_sub_industry", "industry"), F.lit("Unknown")).alias("gics_sub_industry"))


def fill_metadata(panel: DataFrame, meta: DataFrame, columns: tuple[str, ...] = ("gics_sector", "gics_sub_industry")) -> DataFrame:
    """The panel's blank cells from the metadata, else Unknown; others stay."""
    out = panel.join(meta.select("ticker", *[F.col(c).alias(f"_m_{c}") for c in columns]), "ticker", "left")
    own = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in panel.columns else F.lit(None).cast("string")
    return out.withColumns({c: F.coalesce(own(c), F.nullif(F.trim(F.col(f"_m_{c}")), F.lit("")), F.lit("Unknown")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def adjust(rows: DataFrame) -> DataFrame:
    """Vendor rows with raw and adjusted closes as adjusted bars: prices times adjusted over raw, volume as it is.

    The factor is 1 if the raw close is 0 or null; a row without any close is dropped.
    """
    factor = F.coalesce(ratio(F.col("adjusted_close"), F.col("close")), F.lit(1.0))
    close = F.coalesce("adjusted_close", "close")
    new = {c: F.col(c) * F.col("adjustment_factor") for c in ("open", "high", "low")}
    out = rows.withColumns({"adjustment_factor": factor, "raw_close": F.col("close"), "_close": close}).filter(F.col("_close").isNotNull())
    return out.withColumns(new | {"close": F.col("_close"), "dollar_volume": F.col("_close") * F.col("volume"), "adjusted": F.lit(True)}).drop("_close")


def bulk_rows(rows: DataFrame, codes: tuple[str, ...], exchanges: tuple[str, ...]) -> DataFrame:
    """Rows of a whole exchange: symbol, ticker and exchange from the first filled of several spellings."""
    pick = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in names if c in rows.columns], F.lit(None).cast("string"))
    return rows.withColumns({"symbol": vendor_symbol(pick(codes)), "ticker": own_ticker(pick(codes)), "exchange": canonical_exchange(pick(exchanges))}).filter(F.col("ticker").isNotNull())


def aggregate_bars(payloads: DataFrame) -> DataFrame:
    """payload: JSON of a ticker's aggregates with epoch milliseconds. One bar each, with UTC dates and dollar volume."""
    kind = "struct<ticker: string, adjusted: boolean, results: array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double, vw: double, n: bigint>>>"
    rows = payloads.select(F.from_json("payload", kind).alias("p")).select(F.upper("p.ticker").alias("ticker"), F.col("p.adjusted").alias("adjusted"), F.explode("p.results").alias("r"))
    return rows.select("ticker", epoch_ms_date(F.col("r.t")).alias("date"), F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"), F.col("r.v").alias("volume"), "adjusted", (F.col("r.c") * F.col("r.v")).alias("dollar_volume"))


def listing(rows: DataFrame, requested: str | Column, order: str, with_otc: bool = False, is_delisted: bool | None = None) -> DataFrame:
    """The symbol list of a requested exchange as a universe: common shares in USD, the first row of each symbol by `order`.

    A blank exchange is the requested one; blank currencies and types pass. is_delisted is for rows that do not tell.
    """
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    code, currency, kind = F.upper(text("Code")), F.upper(text("Currency")), text("Type")
    exchange = listed_exchange(text("Exchange"), F.lit(requested) if isinstance(requested, str) else requested, with_otc)
    passes = code.isNotNull() & exchange.isNotNull() & (currency.isNull() | (currency == "USD")) & (kind.isNull() | F.lower(kind).contains("common")) & ~other_security(code, F.col("Name"))
    kept = rows.filter(passes).withColumn("_s", vendor_symbol(code)).withColumn("_rn", F.row_number().over(Window.partitionBy("_s").orderBy(order))).filter("_rn = 1")
    delisted = F.coalesce(lenient_bool(text("IsDelisted")), F.lit(is_delisted).cast("boolean"))
    return kept.select(
        F.col("_s").alias("symbol"), own_ticker(F.col("_s")).alias("ticker"), text("Name").alias("name"), text("Country").alias("country"), exchange.alias("exchange"), currency.alias("currency"), kind.alias("type"), text("Isin").alias("isin"), delisted.alias("is_delisted")
    )


def read_sentiment(spark: SparkSession, path: str) -> DataFrame:
    """Sentiment CSV: one row per ticker and date that have both; a count that is no number is 0. Without a file, no rows."""
    kinds = "ticker string, date string, sentiment_count_raw string, sentiment_normalized_raw string"
    try:
        rows = spark.read.csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], kinds)
    text = lambda c: F.trim(F.col(c)) if c in rows.columns else F.lit(None).cast("string")
    count = F.coalesce(lenient_double(text("sentiment_count_raw")), F.lit(0.0)).cast("long").cast("double")
    out = rows.select(
        F.upper(text("ticker")).alias("ticker"), F.substring(text("date"), 1, 10).try_cast("date").alias("date"), count.alias("sentiment_count_raw"), lenient_double(text("sentiment_normalized_raw")).alias("sentiment_normalized_raw")
    )
    return out.filter((F.col("ticker") != "") & F.col("date").isNotNull())


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files named after symbols, one file a row: symbol (`__` stands for a point) and payload. Contents may be bad JSON."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").withColumn("file", F.col("_metadata.file_name"))
    return rows.select(F.regexp_replace(F.regexp_replace("file", r"\.json$", ""), "__", ".").alias("symbol"), F.col("value").alias("payload"))


def read_flat_files(spark: SparkSession, path: str, tickers: DataFrame, schema: StructType | str) -> DataFrame:
    """Compressed CSV files of all tickers, of which only the wanted ones are kept by a semi-join."""
    return spark.read.csv(path, header=True, schema=schema).join(tickers.select("ticker"), "ticker", "left_semi")


def context_rows(spark: SparkSession, path: str | None, panel: DataFrame, tickers: list[str]) -> DataFrame:
    """The context table, or where there is none the context tickers' rows of the panel."""
    try:
        return spark.read.parquet(path) if path else panel.filter(F.col("ticker").isin(tickers))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return panel.filter(F.col("ticker").isin(tickers))


def wiki_constituents(pages: DataFrame) -> DataFrame:
    """page: wikitext with a table of constituents. One row each: symbol, name, sector; links and templates cleared."""

    def plain(x: Column) -> Column:
        for pattern, to in ((r"\{\{[^{}|]*\|([^{}|]*)[^{}]*\}\}", "$1"), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"<ref[^>]*/>|<ref.*?</ref>|<[^>]+>", ""), (r"'''?", "")):
            x = F.regexp_replace(x, pattern, to)
        return F.trim(x)

    rows = pages.select(F.posexplode(F.split("page", r"\n\|-")).alias("at", "row")).filter("at > 0")
    cells = rows.select("at", F.filter(F.split(F.regexp_replace("row", r"\n\|\}[\s\S]*$", ""), r"\n\||\|\|"), lambda c: F.trim(c) != "").alias("c")).filter(F.size("c") >= 3)
    return cells.select(F.col("at").alias("place"), F.upper(plain(F.col("c")[0])).alias("symbol"), plain(F.col("c")[1]).alias("name"), plain(F.col("c")[2]).alias("sector"))


def reappearing_tickers(rows: DataFrame, position: str) -> DataFrame:
    """Tickers whose rows are not together in file order, by consecutive positions: none in a file sorted by ticker.

    A run starts where the row before is not the ticker's, found by an anti-join on ticker and position.
    """
    after = rows.select("ticker", (F.col(position) + 1).alias(position))
    return rows.join(after, ["ticker", position], "left_anti").groupBy("ticker").agg(F.count("*").alias("runs")).filter("runs > 1")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


