import datetime as dt
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import featuresets, upkeep
from ledgerline.operators.cross_section import normalize
from ledgerline.operators.features import daily_features
from ledgerline.sources import sinks
from ledgerline.sources.scratch import shared_dir

DAY = dt.date(2023, 1, 2)
BARS = "ticker string, date date, open double, high double, low double, close double, volume double, dollar_volume double"


def bars(seed=1, tickers=6, days=200):
    r = random.Random(seed)
    rows = {}
    for t in range(tickers):
        price = 50.0
        for d in range(days):
            price *= math.exp(r.gauss(0, 0.02))
            close = None if r.random() < 0.05 else round(price, 3)
            volume = None if r.random() < 0.03 else float(r.randrange(100, 1000))
            rows[(f"T{t}", DAY + dt.timedelta(d))] = (round(price * 0.99, 3), round(price * 1.02, 3), round(price * 0.97, 3), close, volume, None if close is None or volume is None else close * volume)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], BARS)


def plain(df):
    """Rows by key, as they are to nine digits."""
    near = lambda x: None if x is None else f"{x:.9g}" if isinstance(x, float) else x
    return {(r.ticker, r.date): {k: near(v) for k, v in r.asDict().items()} for r in df.collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(re.sub("^file:/+", "/", path)) for f in names if f.endswith(".parquet")}


@pytest.fixture
def tables(spark):
    base = shared_dir(spark)
    tickers = spark.createDataFrame([(f"T{i}", "AB"[i % 2]) for i in range(7)], "ticker string, gics_sector string")
    rows = bars()
    paths = [f"{base}/{x}" for x in ("bars", "features", "normalized")]
    out = upkeep.update_derived(spark, frame(spark, rows), tickers, *paths)
    assert out == {"bars": len(rows), "features": len(rows), "dates": 200}
    return tickers, rows, paths


def rebuilt(spark, rows, tickers):
    made = daily_features(frame(spark, rows))
    return plain(made), plain(normalize(made.join(tickers, "ticker")))


def check(spark, rows, tickers, paths):
    want, wide = rebuilt(spark, rows, tickers)
    assert plain(spark.read.parquet(paths[1]).drop("month")) == want
    got = plain(spark.read.parquet(paths[2]).drop("month"))
    assert got.keys() == wide.keys() and got == wide


def test_derived_tables_after_increments_equal_a_rebuild(spark, tables):
    tickers, rows, paths = tables
    check(spark, rows, tickers, paths)
    day = lambda n: DAY + dt.timedelta(n)
    # A correction in the middle, one that makes a close null, one that repeats what is stored, new days, a new ticker.
    change = {("T1", day(100)): (50.0, 60.0, 40.0, 55.0, 500.0, 27500.0), ("T2", day(101)): (1.0, 1.0, 1.0, None, 5.0, None), ("T3", day(20)): rows[("T3", day(20))]}
    before = [files(p) for p in paths]
    out = upkeep.update_derived(spark, frame(spark, change), tickers, *paths)
    rows |= change
    check(spark, rows, tickers, paths)
    assert out["bars"] == 2 and 0 < out["features"] <= 2 * 75 and out["dates"] < 75
    for old, path in zip(before, paths, strict=True):
        kept, months = old & files(path), lambda x: {p.split("month=")[1][:7] for p in x}
        assert months(old - kept) <= {"2023-04", "2023-05", "2023-06"} and {"2023-01", "2023-02", "2023-03", "2023-07"} <= months(kept)
    more = {("T0", day(200)): (9.0, 10.0, 8.0, 9.5, 100.0, 950.0), ("T6", day(199)): (9.0, 10.0, 8.0, 9.5, 100.0, 950.0)}
    assert upkeep.update_derived(spark, frame(spark, more), tickers, *paths)["features"] == 2
    rows |= more
    check(spark, rows, tickers, paths)
    assert upkeep.update_derived(spark, frame(spark, more), tickers, *paths) == {"bars": 0, "features": 0, "dates": 0}


@pytest.mark.parametrize("broken", ["features", "normalized"])
def test_a_broken_run_is_completed_by_the_next(spark, tables, monkeypatch, broken):
    tickers, rows, paths = tables
    change = {("T1", DAY + dt.timedelta(150)): (50.0, 60.0, 40.0, 55.0, 500.0, 27500.0)}
    done = upkeep.merge_into

    def breaks(spark, path, *more):
        if path.endswith(broken):
            raise RuntimeError("lost")
        done(spark, path, *more)

    monkeypatch.setattr(upkeep, "merge_into", breaks)
    with pytest.raises(RuntimeError):
        upkeep.update_derived(spark, frame(spark, change), tickers, *paths)
    monkeypatch.setattr(upkeep, "merge_into", done)
    upkeep.update_derived(spark, frame(spark, {}), tickers, *paths)
    check(spark, rows | change, tickers, paths)


def test_reached_rows_leave_old_history_out(spark):
    rows = {(f"T{t}", DAY + dt.timedelta(d)): (1.0, 1.0, 1.0, 1.0 + d, 1.0, 1.0) for t in range(2) for d in range(1000)}
    changed = spark.createDataFrame([("T1", DAY + dt.timedelta(700))], "ticker string, date date")
    got = upkeep.reached_rows(frame(spark, rows), changed).agg(F.min("date"), F.max("date"), F.count("*"), F.count_if("reached")).first()
    assert (got[0] - DAY).days == 700 - 122 and (got[1] - DAY).days == 700 + 61 and got[2] == 61 + 1 + 122 and got[3] == 62


def test_moments_merge_in_any_order(spark, tmp_path):
    r = random.Random(5)
    values = [(1e3 + r.gauss(0, 1), None if i % 7 == 0 else r.gauss(-3, 1e-3), None, 4.0) for i in range(3000)]
    whole = spark.createDataFrame(values, "a double, b double, c double, d double")
    one = {x.feature: (x["mean"], x.scale) for x in featuresets.standardizer(whole, list("abcd")).collect()}
    exact = {c: (float(np.mean(v)), float(np.std(v))) for c, v in (("a", [x[0] for x in values]), ("b", [x[1] for x in values if x[1] is not None]))}
    for seed in range(3):
        cuts = sorted(random.Random(seed).sample(range(3000), 11))
        parts = [values[a:b] for a, b in zip([0, *cuts], [*cuts, 3000], strict=True)] + [[]]
        random.Random(seed).shuffle(parts)
        folder = str(tmp_path / f"m{seed}")
        for part in parts:
            featuresets.add_moments(spark.createDataFrame(part, whole.schema), list("abcd"), folder)
        got = {x.feature: (x["mean"], x.scale) for x in featuresets.scales(featuresets.merged_moments(spark.read.parquet(folder))).collect()}
        for c in "ab":
            assert got[c][0] == pytest.approx(exact[c][0], rel=1e-12) and got[c][1] == pytest.approx(exact[c][1], rel=1e-9) and got[c] == pytest.approx(one[c], rel=1e-10)
        assert got["c"] == one["c"] == (None, None) and got["d"] == one["d"] == (4.0, 1.0)


def test_a_manifest_is_observed_in_the_write(spark, tmp_path):
    rows = frame(spark, bars(tickers=4, days=70)).repartition(3)
    sc, store = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("plain", "")
    sinks.write_panel(daily_features(rows), str(tmp_path / "a"))
    sc.setJobGroup("observed", "")
    got = sinks.write_observed(daily_features(rows), str(tmp_path / "b"), str(tmp_path / "m"), extra={"note": "x"})
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [len(store.getJobIdsForGroup(g)) for g in ("plain", "observed")]
    assert jobs[1] <= jobs[0] + 1  # the manifest's own file
    assert got == {"min_date": str(DAY), "max_date": str(DAY + dt.timedelta(69)), "row_count": 280, "ticker_count": 4, "note": "x"}
    assert plain(spark.read.parquet(str(tmp_path / "b"))) == plain(spark.read.parquet(str(tmp_path / "a")))
    assert sinks.write_observed(rows.limit(0), str(tmp_path / "c"), str(tmp_path / "n"))["row_count"] == 0
