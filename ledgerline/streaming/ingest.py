"""Streaming ingestion of bars: idempotent merges of all that comes, and event-time windows on events."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.upsert import merge_into


def stream_bars(spark: SparkSession, source: str, schema, table: str, checkpoint: str, keys: tuple[str, ...] = ("ticker", "date", "adjusted")):
    """Merges files of bars into a table partitioned by month as they come; a batch that runs again changes nothing.

    Every row with a key is merged, however old: what a fetch asks for is bounded where it is made (`fetch_start`), not
    here. Of rows with one key the one in the later file counts, in one file the later row. Tickers are in capitals;
    keys that the files lack are left out, and an unknown `adjusted` counts as true. Rows without a key go to the table
    `{table}_unkeyed`. Returns the started query, which takes what is there and ends.
    """

    def batch(rows: DataFrame, _: int) -> None:
        own = [k for k in keys if k in rows.columns]
        rows = rows.withColumns({"ticker": F.upper("ticker"), "month": F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none"))} | ({"adjusted": F.coalesce("adjusted", F.lit(True))} if "adjusted" in own else {}))
        keyed = reduce(and_, [F.col(k).isNotNull() for k in own])
        if not rows.filter(~keyed).isEmpty():
            merge_into(spark, f"{table.rstrip('/')}_unkeyed", rows.filter(~keyed).drop("_came"), [c for c in rows.columns if c != "_came"], "month", None)
        if not rows.filter(keyed).isEmpty():
            merge_into(spark, table, rows.filter(keyed), [*own, "month"], "month", "_came")

    came = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("_came")
    stream = spark.readStream.schema(schema).parquet(source).select("*", came)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 day", step: str | None = None) -> DataFrame:
    """Events, count and total value per type and window, tumbling or sliding; the same on a stream or a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step or width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with less than a gap between them: start, the last one's end, events and total value."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total")
