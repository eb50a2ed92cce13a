"""Merging increments: incoming rows win, first rows win, columns widen, only touched partitions are rewritten."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.sources.scratch import MADE, delete_folder, shared_dir


def merge(base: DataFrame, incoming: DataFrame, keys: list[str], arrival: str | None) -> DataFrame:
    """The union with one row a key: an incoming row replaces the base's, and of several incoming ones the last to arrive.

    arrival is a column of `incoming` that orders its rows (a number, a time, a struct of them), and is not kept. None
    says that no key comes twice; if one does all the same, the largest by all columns stays. Of rows of the base that
    share a key the largest stays.
    """
    came = F.col(arrival).alias("_came") if arrival else F.lit(None).cast("long").alias("_came")
    new = incoming.select(*[c for c in incoming.columns if c != arrival], came, F.lit(1).alias("_new"))
    old = base.withColumn("_came", F.lit(None).cast(new.schema["_came"].dataType)).withColumn("_new", F.lit(0))
    both = old.unionByName(new, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc_nulls_last("_came"), *[F.desc_nulls_last(c) for c in both.columns if c not in (*keys, "_new", "_came")])
    return both.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn", "_new", "_came")


def union_first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """The union with one row a key: the earliest part's; within a part the first by the other columns."""
    stacked = parts[0].withColumn("_part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        stacked = stacked.unionByName(part.withColumn("_part", F.lit(i)), allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("_part", *[c for c in stacked.columns if c not in (key, "_part")])
    return stacked.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn", "_part")


def widen(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def missing_rows(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not there yet."""
    return wanted.join(have, keys, "left_anti")


def eligible_only(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys, on, "left_semi")


def without_tickers(panel: DataFrame, context: list[str]) -> DataFrame:
    return panel.filter(~F.col("ticker").isin([t.upper() for t in context])) if context else panel


def fetch_start(latest: date | None, fallback: date, overlap: int) -> date:
    """Where the next fetch begins: the fallback without data, the next day without overlap, else so many days back."""
    if latest is None:
        return fallback
    return latest + timedelta(days=1) if overlap <= 0 else latest - timedelta(days=overlap - 1)


def summary(panel: DataFrame) -> DataFrame:
    """One row for a manifest: first and last date, rows, tickers."""
    return panel.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count("*").alias("row_count"), F.countDistinct("ticker").alias("ticker_count"))


def status_counts(rows: DataFrame, role: str = "role", status: str = "status") -> DataFrame:
    return rows.groupBy(role, status).agg(F.count("*").alias("rows"))


#: Partitions that are named in a filter; more are found by a semi-join.
NAMED = 1000


def merge_into(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partition: str, arrival: str | None) -> None:
    """Merge into a Parquet table partitioned by a column, rewriting only the partitions that the increment touches.

    Touched partitions are named in the filter of the read, so that others are pruned when the plan is made; the new
    files replace theirs by dynamic partition overwrite when the job commits. Rows are written aside first, as a job may
    not overwrite what it reads: in a folder of this merge's own, which is deleted.
    """
    there = _read(spark, path)
    if there is None:
        there = spark.createDataFrame([], incoming.drop(*([arrival] if arrival else [])).schema)
    touched = incoming.select(partition).distinct()
    named = [r[0] for r in touched.take(NAMED + 1)]
    base = there.filter(F.col(partition).isin(named)) if len(named) <= NAMED else there.join(touched, partition, "left_semi")
    aside = shared_dir(spark)
    merge(base, incoming, keys, arrival).write.parquet(aside)
    try:
        spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    finally:
        delete_folder(spark, aside)
        MADE.remove(aside)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none or it has no file."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def add_increment(increment: DataFrame, folder: str) -> None:
    """Keep an increment beside its table until it is consolidated: files are added, none is rewritten."""
    increment.withColumn("_added", F.current_timestamp()).write.mode("append").parquet(folder)


def with_increments(spark: SparkSession, table: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The table as consolidating its increments would leave it; the last one added counts."""
    more = _read(spark, folder)
    return table if more is None else merge(table, more, keys, "_added")


def consolidate(spark: SparkSession, path: str, folder: str, keys: list[str], partition: str, archive: str | None = None) -> None:
    """Merge the increments of a folder into the table, and move their files to the archive, or delete them without one.

    Only files that were there at the start are merged and moved, so increments may be added meanwhile. A run that broke
    off can be repeated: merging once more changes nothing.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    more = _read(spark, folder)
    files = [] if more is None else more.inputFiles()
    if not files:
        return
    merge_into(spark, path, spark.read.parquet(*files), keys, partition, "_added")
    for name in files:
        source = jvm.org.apache.hadoop.fs.Path(name)
        system = source.getFileSystem(conf)
        if archive is None:
            system.delete(source, False)
            continue
        target = jvm.org.apache.hadoop.fs.Path(archive)
        system.mkdirs(target)
        system.rename(source, jvm.org.apache.hadoop.fs.Path(target, source.getName()))


def state_rows(state: DataFrame, increment: DataFrame, n: int = 320, arrival: str | None = None) -> DataFrame:
    """The bounded state of each ticker after an increment: its last n rows, from which windows up to n rows can go on."""
    both = merge(state, increment, ["ticker", "date"], arrival)
    last = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return both.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= n).drop("_rn")
