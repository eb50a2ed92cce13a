"""Daily features on a stream: each ticker's last bars are kept as state, so that a bar gives its features when it comes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DateType, DoubleType, StringType, StructField, StructType

from ledgerline.operators.features import DAILY, DAILY_FLAGS
from ledgerline.operators.upkeep import REACH, months
from ledgerline.operators.upsert import merge_into

NUMBERS = ["open", "high", "low", "close", "volume", "dollar_volume"]
#: Bars that are kept of a ticker, and those of them that a row's windows may need before it.
KEPT, NEEDED = 320, 2 * REACH
DAY_MS = 86_400_000


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def _dense(values: pd.Series, n: int, f: Callable) -> pd.Series:
    """f over the last n values that are not null, where the row has one and there are so many."""
    present = values.dropna()
    if len(present) < n:
        return pd.Series(np.nan, values.index)
    found = f(np.lib.stride_tricks.sliding_window_view(present.to_numpy(), n), axis=1)
    return pd.Series(found, present.index[n - 1 :]).reindex(values.index)


def bar_features(bars: pd.DataFrame) -> pd.DataFrame:
    """What `daily_features` gives, for the bars of one ticker by date."""
    open_, high, low, close, volume, dollars = (bars[c] for c in NUMBERS)
    prev = close.ffill().shift(1)
    returns = _ratio(close, prev) - 1
    ranges = pd.concat([high - low, (high - prev).abs(), (low - prev).abs()], axis=1).max(axis=1)
    out = {
        "prev_close": prev, "return_1d": returns, "log_return_1d": np.log1p(returns.where(returns > -1)), "gap_pct": _ratio(open_, prev) - 1, "intraday_return": _ratio(close, open_) - 1,
        "hl_range_pct": _ratio(high - low, close), "close_location": _ratio(close - low, high - low).where(close != 0).where(close.notna()), "true_range_pct": _ratio(ranges, prev).where(high.notna() & low.notna()),
    }
    mean, deviation, first = np.mean, np.std, lambda w, axis: w[:, 0]
    out |= {f"rolling_return_{n}d": _ratio(close, _dense(close, n, first)) - 1 for n in (5, 20, 60)}
    out |= {f"rolling_vol_{n}d": _dense(returns, n, deviation) for n in (20, 60)}
    out |= {f"rolling_avg_volume_{n}d": _dense(volume, n, mean) for n in (20, 60)} | {f"rolling_avg_dollar_volume_{n}d": _dense(dollars, n, mean) for n in (20, 60)}
    out |= {f"sma_close_{n}d": _dense(close, n, mean).where(close.notna(), _dense(close, n - 1, mean).ffill()) for n in (20, 60)}
    out |= {f"price_vs_sma_{n}d": (_ratio(close, out[f"sma_close_{n}d"]) - 1).where(close != 0) for n in (20, 60)}
    out |= {f"momentum_{n}d": out[f"rolling_return_{n}d"] for n in (20, 60)}
    out |= {
        "volume_ratio_20d": _ratio(volume, out["rolling_avg_volume_20d"]).where(volume != 0), "dollar_volume_ratio_5d": _ratio(dollars, _dense(dollars, 5, mean)).where(dollars != 0),
        "volume_zscore_20d": _ratio(volume - out["rolling_avg_volume_20d"], _dense(volume, 20, deviation)),
    }
    before = close.notna().cumsum() - close.notna()
    out |= {"has_prev_close": prev.notna(), "has_20d_history": before >= 19, "has_60d_history": before >= 59}
    return pd.concat([bars, pd.DataFrame(out)[[*DAILY, *DAILY_FLAGS]]], axis=1)


_BARS = StructType([StructField("date", DateType()), *[StructField(c, DoubleType()) for c in NUMBERS]])
FEATURES = StructType([StructField("ticker", StringType()), *_BARS, *[StructField(c, DoubleType()) for c in DAILY], *[StructField(c, BooleanType()) for c in DAILY_FLAGS], StructField("too_late", BooleanType())])


class _Features(StatefulProcessor):
    def __init__(self, kept: int, idle_ms: int):
        self.kept, self.idle_ms = kept, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("bars", _BARS, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        own = [*rows]
        come = pd.concat(own).sort_values("came", kind="stable").drop_duplicates("date", keep="last").sort_values("date")
        held = pd.DataFrame([tuple(r) for r in self.state.get()] if self.state.exists() else [], columns=["date", *NUMBERS])
        # Of a cut state the first bars are there for the windows of the others alone.
        least = held["date"].iloc[NEEDED] if len(held) >= self.kept else None
        late = come["date"] < least if least is not None else pd.Series(False, come.index)
        new = come[~late]
        if late.any():
            yield self._shaped(key, come.loc[late, ["date", *NUMBERS]].assign(too_late=True))
        if new.empty:
            return
        both = pd.concat([x for x in (held, new[["date", *NUMBERS]]) if len(x)]).drop_duplicates("date", keep="last").sort_values("date").reset_index(drop=True)
        both[NUMBERS] = both[NUMBERS].astype(float)
        made = bar_features(both)
        changed = made["date"] >= new["date"].min()
        yield self._shaped(key, made[changed].assign(too_late=False))
        last = both.tail(self.kept).astype(object).where(both.tail(self.kept).notna(), None)
        self.state.put([tuple(r) for r in last.itertuples(index=False)])

    def _shaped(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(ticker=key[0]).reindex(columns=FEATURES.names)

    def close(self) -> None:
        pass


def with_features(bars: DataFrame, kept: int = KEPT, idle_days: int = 365) -> DataFrame:
    """A stream of bars with the daily features of each bar that comes, and of the later ones that it changes.

    bars: ticker, date, the numbers of a bar and `came`, by which of several bars of a date in one batch the last one
    counts. State is a ticker's last `kept` bars, over 2 * REACH; it is given up when none has come for idle_days. A bar
    that is older than what is kept can give features for comes back with too_late and no features: its rows are work
    for `update_derived`. Columns of more than REACH missing values in what is kept have shorter windows than in a batch.
    For the session the state store is set to RocksDB, as such state asks for it, and batches without data are off. Rows without ticker or date are left out.
    """
    if kept <= NEEDED:
        raise ValueError(f"windows need more than {NEEDED} bars")
    conf = bars.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # state that expires would ask for one after another
    known = bars.filter("ticker IS NOT NULL AND date IS NOT NULL").select("ticker", "date", *[F.col(c).cast("double").alias(c) for c in NUMBERS], "came")
    return known.groupBy("ticker").transformWithStateInPandas(_Features(kept, idle_days * DAY_MS), FEATURES, "Update", "ProcessingTime")


def stream_features(spark: SparkSession, source: str, table: str, checkpoint: str, kept: int = KEPT, idle_days: int = 365):
    """Files of bars as they come, their features merged into a table by month; bars that come too late go to `{table}_late`.

    A batch that runs again changes nothing in the table. Returns the started query, which takes what is there and ends.
    """
    schema = StructType([StructField("ticker", StringType()), *_BARS])
    came = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    bars = spark.readStream.schema(schema).parquet(source).withColumn("came", F.to_json(came))

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()  # computed once: state moves on with it
        late = rows.filter("too_late").select("ticker", "date", *NUMBERS)
        if not late.isEmpty():
            merge_into(spark, f"{table.rstrip('/')}_late", months(late), ["ticker", "date", "month"], "month", None)
        made = rows.filter("NOT too_late").drop("too_late")
        if not made.isEmpty():
            merge_into(spark, table, months(made), ["ticker", "date", "month"], "month", None)
        rows.unpersist()

    return with_features(bars, kept, idle_days).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
