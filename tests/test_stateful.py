import datetime as dt

import pandas as pd
import pytest
from test_upkeep import DAY, bars, frame

from ledgerline.operators.features import daily_features
from ledgerline.streaming import stateful


def near(df):
    rows = {}
    for r in df.collect():
        rows[(r.ticker, r.date)] = {k: None if v is None else pytest.approx(v, rel=1e-8, abs=1e-10) if isinstance(v, float) else v for k, v in r.asDict().items()}
    return rows


def exact(df):
    return {(r.ticker, r.date): r.asDict() for r in df.collect()}


def test_features_of_one_ticker_equal_the_batch(spark):
    rows = {k: v for k, v in bars(seed=3, tickers=1, days=220).items()}
    table = pd.DataFrame([(k[1], *v) for k, v in rows.items()], columns=["date", *stateful.NUMBERS])
    table[stateful.NUMBERS] = table[stateful.NUMBERS].astype(float)
    got = stateful.bar_features(table)
    want = near(daily_features(frame(spark, rows)))
    for r in got.to_dict("records"):
        own = want[("T0", r["date"])]
        assert {k: None if v != v else v for k, v in r.items()} == {k: v for k, v in own.items() if k != "ticker"}


def test_stream_gives_features_as_bars_come_late_or_again(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    rows = bars(seed=4, tickers=3, days=330)
    day = lambda n: DAY + dt.timedelta(n)

    def load(some, kept=200):
        frame(spark, some).coalesce(1).write.mode("append").parquet(source)
        stateful.stream_features(spark, source, table, checkpoint, kept).awaitTermination()
        return exact(spark.read.parquet(table).drop("month"))

    late = {("T1", day(310)), ("T2", day(270))}
    first = {k: v for k, v in rows.items() if k[1] < day(250) and k not in late}
    second = {k: v for k, v in rows.items() if day(250) <= k[1] and k not in late}
    assert load(first) == near(daily_features(frame(spark, first)))
    # Each load starts the query anew from its checkpoint.
    assert load(second) == near(daily_features(frame(spark, first | second)))
    known = first | second
    got = load({k: rows[k] for k in late} | {("T0", day(320)): (1.0, 2.0, 0.5, 1.5, 10.0, 15.0)})
    known |= {k: rows[k] for k in late} | {("T0", day(320)): (1.0, 2.0, 0.5, 1.5, 10.0, 15.0)}
    assert got == near(daily_features(frame(spark, known)))
    # What the state cannot give features for is told apart, and nothing else changes.
    assert load({("T0", day(5)): (1.0, 2.0, 0.5, 1.5, 10.0, 15.0)}) == got
    assert [(r.ticker, r.date, r.close) for r in spark.read.parquet(table + "_late").collect()] == [("T0", day(5), 1.5)]
    with pytest.raises(ValueError, match="more than 122"):
        stateful.with_features(frame(spark, {}), 100)
