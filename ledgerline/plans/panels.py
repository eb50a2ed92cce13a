"""Panels derived from the star-schema tables, in the shape of daily bars.

Ticker is the supplier, date the ship date, price the price per unit, sector the supplier's region; the benchmark is
all suppliers of a date, the sector context all of a region and date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.sliding import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, gics_sector, exchange, type, name of each supplier. Exchange and type follow from the keys."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("ticker"),
        F.col("r_name").alias("gics_sector"),
        F.when(F.col("s_suppkey") % 7 == 0, "OTC").when(F.col("s_suppkey") % 3 == 0, "NYSE MKT").when(F.col("s_suppkey") % 3 == 1, "nyse").otherwise("NASDAQ").alias("exchange"),
        F.when(F.col("s_suppkey") % 9 == 0, "ETF").when(F.col("s_suppkey") % 5 == 0, "").otherwise("Common Stock").alias("type"),
        F.col("s_name").alias("name"),
    )


def items(spark: SparkSession, sf_dir: str) -> int:
    """How many items there are, of which no fewer than bars."""
    return table(spark, sf_dir, "lineitem").count()


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ticker and date: first, highest, lowest and last price, quantity and dollar volume.

    Few items share a ticker and date, so summing them up before a shuffle would spare little: items are dealt by ticker,
    which the sums and all windows by ticker then go on with.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("ticker"),
        F.col("l_shipdate").cast("date").alias("date"),
        *(order := ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity"]),
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    own = dealt(rows, items(spark, sf_dir), "ticker").select("ticker", "date", price.alias("p"), F.col("l_quantity").alias("q"), F.struct(*order).alias("k"))
    out = own.groupBy("ticker", "date").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("q").alias("volume"))
    return out.withColumn("dollar_volume", F.col("close") * F.col("volume"))


def holed(panel: DataFrame) -> DataFrame:
    """The bars with closes missing by a rule of ticker and day, for null semantics."""
    hole = (F.substring("ticker", 2, 6).cast("int") * 31 + F.dayofmonth("date")) % 7 == 0
    return panel.withColumn("close", F.when(~hole, F.col("close"))).withColumn("dollar_volume", F.when(~hole, F.col("dollar_volume")))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark (ticker MKT) and sector (ticker of the region) bars: the average price per unit and the quantity.

    Regions by supplier, two short columns, are broadcast: only sums by date are shuffled.
    """
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    regions = tickers(spark, sf_dir).select(F.substring("ticker", 2, 6).cast("long").alias("k"), F.col("gics_sector").alias("sector"))
    both = rows.withColumn("ticker", F.lit("MKT")).select("ticker", "date", "l_extendedprice", "l_quantity").unionAll(
        rows.join(F.broadcast(regions), F.col("l_suppkey") == F.col("k")).select(F.col("sector").alias("ticker"), "date", "l_extendedprice", "l_quantity")
    )
    money, units = (F.sum(F.col(c).cast("decimal(18,2)")).cast("double") for c in ("l_extendedprice", "l_quantity"))
    out = both.groupBy("ticker", "date").agg((money / units).alias("close"), units.alias("volume"))
    return out.select("ticker", "date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], "volume", (F.col("close") * F.col("volume")).alias("dollar_volume"))


def panel(spark: SparkSession, sf_dir: str, listed: DataFrame | None = None) -> DataFrame:
    """The bars with each ticker's sector, exchange and type, or with what else is listed of it.

    Each task looks up its own tickers: they are not broadcast, and the bars stay in order for the windows by ticker.
    """
    return bars(spark, sf_dir).join((tickers(spark, sf_dir) if listed is None else listed).hint("shuffle_hash"), "ticker")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing per ticker and quarter, available 45 days after the quarter's end, and a yearly one for each year.

    A year's sums are those of its quarters, so items are summed up once; decimals are exact.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("ticker"),
        F.col("l_shipdate").cast("date").alias("d"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("v"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")).alias("c"),
    )
    quarter = F.date_sub(F.add_months(F.trunc("d", "quarter"), 3), 1)
    year = F.date_sub(F.add_months(F.trunc("d", "year"), 12), 1)
    sums = rows.groupBy("ticker", quarter.alias("d")).agg(F.sum("v").alias("v"), F.sum("c").alias("c"))
    both = F.array(*[F.struct(end.alias("source_period_end"), F.lit(name).alias("source_frequency")) for end, name in ((F.col("d"), "quarterly"), (year, "yearly"))])
    parts = sums.select("ticker", "v", "c", F.explode(both).alias("p")).select("ticker", "v", "c", "p.*")
    out = parts.groupBy("ticker", "source_period_end", "source_frequency").agg(F.sum("v").cast("double").alias("fundamental_revenue"), F.sum("c").cast("double").alias("fundamental_net_income"))
    return out.withColumn("availability_date", F.date_add("source_period_end", 45))


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and day as count and mean: ticker is the user."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.col("ts").cast("date").alias("date")).agg(
        F.count("*").cast("double").alias("sentiment_count_raw"), (F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("sentiment_normalized_raw")
    )
