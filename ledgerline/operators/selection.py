"""Choosing rows: latest, tail, top, sampled, calendar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerline.functions.scalars import weekday_calendar


def latest_rows(panel: DataFrame, stale_days: int | None = None) -> DataFrame:
    """Each ticker's last row, if it is not older than `stale_days` days before the panel's newest date."""
    order = Window.partitionBy("ticker").orderBy(F.desc("date"))
    last = panel.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")
    if stale_days is None:
        return last
    return last.filter(F.col("date") >= F.date_sub(panel.agg(F.max("date")).scalar(), stale_days))


def latest_keys(bars: DataFrame, stale_days: int) -> DataFrame:
    """ticker, date of each ticker's last row, as latest_rows chooses it, by partial aggregates of the keys alone."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("date"))
    return last.filter(F.col("date") >= F.date_sub(bars.agg(F.max("date")).scalar(), stale_days))


def tail_rows(panel: DataFrame, n: int) -> DataFrame:
    """Each ticker's last n rows."""
    order = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return panel.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def tail_episodes(episodes: DataFrame, k: int, date: str = "anchor_date") -> DataFrame:
    """The last k episodes by date and ticker: a top-k, not a sort of all."""
    return episodes.orderBy(F.desc(date), F.desc("ticker")).limit(k)


def hash_sample(rows: DataFrame, k: int, date: str = "date") -> DataFrame:
    """k rows of each date, by a hash of date, ticker and the row's number for its ticker: the same at every run.

    Each task first keeps its own k rows of each date, all that can be among the k of all, so that no task sorts what it reads.
    """
    key = F.sha2(F.concat_ws("|", F.col(date).cast("string"), F.upper("ticker"), F.col("window_row_count").cast("string")), 256)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= HELD_ROWS:
                held = _first_by_key(held, k, date)
        if held:
            yield from _first_by_key(held, k, date)

    keyed = rows.withColumn("_key", key)
    first = keyed.mapInArrow(task, StructType([*rows.schema.fields, StructField("_key", StringType())]))
    return first.withColumn("_rn", F.row_number().over(Window.partitionBy(date).orderBy("_key", "ticker"))).filter(F.col("_rn") <= k).select(*rows.columns)


#: Rows that a task gathers before it keeps the first of each date.
HELD_ROWS = 100_000


def _first_by_key(held: list[pa.RecordBatch], k: int, date: str) -> list[pa.RecordBatch]:
    """The k rows of each date with the smallest keys, ties by ticker."""
    table = pa.Table.from_batches(held).combine_chunks()
    table = table.take(pc.sort_indices(table, sort_keys=[(date, "ascending"), ("_key", "ascending"), ("ticker", "ascending")], null_placement="at_start"))
    codes = pc.dictionary_encode(table[date].combine_chunks(), null_encoding="encode").indices.to_numpy()
    opens = np.flatnonzero(np.diff(codes, prepend=-1))
    place = np.arange(len(codes)) - np.repeat(opens, np.diff(opens, append=len(codes)))
    return table.filter(pa.array(place < k)).combine_chunks().to_batches()


def latest_liquid(panel: DataFrame, n: int, floor: float, least_price: float = 0.0) -> DataFrame:
    """The n tickers with the largest dollar volume (its 60-day average where the panel has one) in their latest row that
    reaches the floors of volume and price. A floor of 0 passes all."""
    measure = F.coalesce(*[F.col(c) for c in ("rolling_avg_dollar_volume_60d", "dollar_volume") if c in panel.columns])
    rows = panel.withColumn("dollar_volume", measure)
    for column, least in (("dollar_volume", floor), ("close", least_price)):
        rows = rows.filter(F.col(column) >= least) if least else rows
    return latest_rows(rows).orderBy(F.desc_nulls_last("dollar_volume"), F.desc("date"), "ticker").limit(n).select("ticker", "date", "dollar_volume")


def first_tickers(panel: DataFrame, n: int, position: str) -> DataFrame:
    """The n tickers that come first in the order of a column, as of rows in a file; ties by ticker."""
    return panel.groupBy("ticker").agg(F.min(position).alias("_first")).orderBy("_first", "ticker").limit(n).select("ticker")


def sample_universe(bars: DataFrame, n: int, forced: list[str], benchmark: str) -> DataFrame:
    """ticker, place: forced tickers first, then by median dollar volume, ties by ticker from the last; the benchmark is added at the end."""
    spark = bars.sparkSession
    names = list(dict.fromkeys(t.upper() for t in forced if t))
    medians = bars.filter(F.col("dollar_volume").isNotNull()).groupBy(F.upper("ticker").alias("ticker")).agg(F.percentile("dollar_volume", F.lit(0.5)).alias("m"))
    rest = medians.filter((F.col("ticker") != benchmark) & ~F.col("ticker").isin(names)).orderBy(F.desc("m"), F.desc("ticker")).limit(max(1 if len(names) >= n else 0, n - len(names)))
    placed = rest.select("ticker", (F.row_number().over(Window.orderBy(F.desc("m"), F.desc("ticker"))) + len(names)).alias("place"))
    first = spark.createDataFrame([(t, i + 1) for i, t in enumerate(names)], "ticker string, place int")
    chosen = first.unionByName(placed)
    if benchmark in names:
        return chosen
    return chosen.unionByName(chosen.agg((F.coalesce(F.max("place"), F.lit(0)) + 1).alias("place")).select(F.lit(benchmark).alias("ticker"), "place"))


def latest_windows(panel: DataFrame, length: int, cutoff=None) -> DataFrame:
    """Each ticker's last full window of rows up to the cut-off: its first and last date and number of rows."""
    rows = panel if cutoff is None else panel.filter(F.col("date") <= cutoff)
    order = Window.partitionBy("ticker").orderBy(F.desc("date"))
    out = rows.withColumns({"_rn": F.row_number().over(order), "window_start_date": F.lead("date", length - 1).over(order)})
    return out.filter((F.col("_rn") == 1) & F.col("window_start_date").isNotNull()).select("ticker", F.col("date").alias("anchor_date"), "window_start_date", F.col("date").alias("window_end_date"), F.lit(length).alias("available_window_rows"), F.lit("pending").alias("target_status"))


def date_ticker_filter(panel: DataFrame, start=None, end=None, tickers: DataFrame | None = None) -> DataFrame:
    """Rows in the date range and of the allowed tickers."""
    out = panel
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out if tickers is None else out.join(tickers, "ticker", "left_semi")


def weekdays(spark, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(weekday_calendar(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
