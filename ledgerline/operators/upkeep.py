"""Upkeep of derived tables after an increment of bars: features of the rows that it reaches, then cross-sections of their dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators.cross_section import normalize
from ledgerline.operators.features import by_day, daily_features, moves
from ledgerline.operators.upsert import merge, merge_into
from ledgerline.sources.scratch import delete_folder, materialize

#: Values that are not null over which the longest window goes, and one more for the close before them.
REACH = 61
#: What windows are made of.
WINDOWED = ("close", "return_1d", "volume", "dollar_volume")


def months(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.date_format("date", "yyyy-MM"))


def reached_rows(bars: DataFrame, changed: DataFrame, reach: int = REACH) -> DataFrame:
    """The bars around each ticker's changed dates, with `reached`: whether a changed bar is in one of the row's windows.

    bars are those after the change, changed has ticker and date. A window of the last n values that are not null reaches
    as far as the n-th such value after a change, so values are counted, each column for itself. Rows whose values are in
    windows of reached ones are kept, older ones are not, nor are later ones that no change reaches.
    """
    span = changed.groupBy("ticker").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    own = moves(bars.join(span, "ticker")).select(*bars.columns, "_from", "_to", "return_1d")
    count = {f"_n_{c}": F.count(c).over(by_day().rowsBetween(Window.unboundedPreceding, 0)) for c in WINDOWED}
    whole = Window.partitionBy("ticker")
    counted = own.withColumns(count)
    first = {f"_a_{c}": F.coalesce(F.max(F.when(F.col("date") < F.col("_from"), F.col(f"_n_{c}"))).over(whole), F.lit(0)) for c in WINDOWED}
    last = {f"_b_{c}": F.coalesce(F.max(F.when(F.col("date") <= F.col("_to"), F.col(f"_n_{c}"))).over(whole), F.lit(0)) for c in WINDOWED}
    placed = counted.withColumns(first | last)
    near = F.greatest(*[F.col(f"_n_{c}") - F.col(f"_a_{c}") for c in WINDOWED]) > -2 * reach
    within = F.least(*[F.col(f"_n_{c}") - F.col(f"_b_{c}") for c in WINDOWED]) <= reach
    reached = (F.col("date") >= F.col("_from")) & within
    return placed.withColumn("reached", reached).filter(near & within).select(*bars.columns, "reached")


def reached_features(bars: DataFrame, changed: DataFrame, reach: int = REACH) -> DataFrame:
    """The daily features of reached rows alone."""
    return daily_features(reached_rows(bars, changed, reach)).filter("reached").drop("reached")


def update_derived(spark: SparkSession, increment: DataFrame, tickers: DataFrame, bars: str, features: str, normalized: str, keys: tuple[str, ...] = ("ticker", "date")) -> dict:
    """Merge an increment into the bars and bring the features and normalised features after it, all tables by month.

    Only bars that differ from what is stored count as changes; of these tickers the rows that changed bars reach are
    computed anew, and those that come out otherwise are merged. Their dates are normalised over all tickers of
    `tickers` (ticker, gics_sector) and merged. Each table has one dynamic overwrite of the months that it touches; other
    months' files stay. What is still to be done is noted before each overwrite, so a run that broke off is completed by
    the next one, with whatever increment. Returns the changed bars, rows and dates.
    """
    notes = {k: f"{v.rstrip('/')}_todo" for k, v in {"bars": bars, "dates": normalized}.items()}
    old = _stored(spark, bars, months(increment).schema)
    new = months(increment)
    fresh = materialize(_differing(merge(_of_months(old, new).join(new.select(*keys).distinct(), list(keys), "left_semi"), new, list(keys), None), old, list(keys)))
    if not fresh.isEmpty():
        fresh.select(*keys).write.mode("append").parquet(notes["bars"])
        merge_into(spark, bars, fresh, [*keys, "month"], "month", None)
    todo = _stored(spark, notes["bars"], fresh.select(*keys).schema)
    changed = materialize(todo.distinct())
    rows = dates = 0
    if not changed.isEmpty():
        made = months(reached_features(spark.read.parquet(bars).drop("month"), changed))
        before = _stored(spark, features, made.schema)
        moved = materialize(_differing(made, before, list(keys)))
        rows = moved.count()
        if rows:
            moved.select("date").distinct().write.mode("append").parquet(notes["dates"])
            merge_into(spark, features, moved, [*keys, "month"], "month", None)
    delete_folder(spark, notes["bars"])
    touched = materialize(_stored(spark, notes["dates"], changed.select("date").schema).distinct())
    if not touched.isEmpty():
        dates = touched.count()
        named = _of_months(spark.read.parquet(features), months(touched))
        panel = named.join(F.broadcast(touched) if dates <= 10_000 else touched, "date", "left_semi").drop("month").join(tickers.select("ticker", "gics_sector"), "ticker")
        merge_into(spark, normalized, months(normalize(panel)), [*keys, "month"], "month", None)
    delete_folder(spark, notes["dates"])
    return {"bars": fresh.count(), "features": rows, "dates": dates}


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at a path, or an empty one."""
    from ledgerline.operators.upsert import _read

    found = _read(spark, path)
    return spark.createDataFrame([], schema) if found is None else found


def _of_months(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table's partitions that the rows lie in."""
    return table.join(F.broadcast(rows.select("month").distinct()), "month", "left_semi")  # a few hundred months at most


def _differing(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the table lacks or has otherwise; columns that one of them lacks count as null."""
    names = [c for c in rows.columns if c not in keys]
    there = _of_months(table, rows).select(*keys, F.struct(*[F.col(c) if c in table.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]).alias("_was"))
    met = rows.join(there, keys, "left")
    return met.filter(F.col("_was").isNull() | ~F.struct(*names).eqNullSafe(F.col("_was"))).select(rows.columns)
