"""Writing tables and manifests. Spark's commit protocol makes a table appear whole or not at all."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerline.operators.upsert import summary


def write_panel(panel: DataFrame, path: str, partition: str | None = "month") -> None:
    """Parquet by month, rows of a ticker together, so that scans prune dates by folder and tickers by file statistics."""
    out = panel.withColumn("month", F.date_format("date", "yyyy-MM")) if partition == "month" else panel
    out = out.repartition(*([F.col(partition)] if partition else []), F.col("ticker")).sortWithinPartitions(*([partition] if partition else []), "ticker", "date")
    writer = out.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_observed(panel: DataFrame, path: str, manifest: str, partition: str | None = "month", extra: dict | None = None) -> dict:
    """The panel as write_panel writes it, and its manifest from the rows as they were written, without reading them again.

    Tickers are counted by each one's first row, which takes a sort by ticker and, where rows are dealt by it as those of
    windows over tickers are, no shuffle. A row without a ticker or date counts as a row, and in neither extent.
    """
    seen = Observation()
    first = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) == 1
    counted = panel.withColumn("_first", first & F.col("ticker").isNotNull()).observe(
        seen, F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("_first")).alias("ticker_count")
    )
    write_panel(counted.drop("_first"), path, partition)
    try:
        found = seen.get
    except Py4JJavaError:  # a plan that is known to have no rows is not run, and nothing is observed
        found = {"min_date": None, "max_date": None, "row_count": 0, "ticker_count": 0}
    return _write_json(panel, manifest, found | (extra or {}))


def _write_json(panel: DataFrame, path: str, row: dict) -> dict:
    row = {k: str(v) if v is not None and not isinstance(v, (int, float, str, list, dict)) else v for k, v in row.items()}
    panel.sparkSession.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return row


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_manifest(panel: DataFrame, path: str, extra: dict | None = None) -> dict:
    """A JSON file of the panel's extent beside what the caller adds; one row goes to the driver."""
    return _write_json(panel, path, summary(panel).first().asDict() | (extra or {}))


def fresher(spark, normalized: str, processed: str) -> str:
    """The normalized table if it is at least as new as the processed one, by their files' times; else the processed."""

    def newest(path: str):
        try:
            return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.max("modificationTime")).first()[0]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    a, b = newest(normalized), newest(processed)
    return normalized if a is not None and (b is None or a >= b) else processed
