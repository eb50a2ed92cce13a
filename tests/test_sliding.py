import datetime
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import cross_section, features, sliding
from ledgerline.operators.sliding import Sliding

DAY = datetime.date(2024, 1, 1)


def test_sliding_equals_brute_force(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # tickers go on over batches
    r = random.Random(5)
    rows = [(t, DAY + datetime.timedelta(days=i), r.choice([None, 2.5, r.random(), r.random()])) for t, n in (("A", 30), ("B", 2), ("C", 11), (None, 9)) for i in range(n)]
    frame = spark.createDataFrame(r.sample(rows, len(rows)), "ticker string, date date, x double")
    new = {f"{k}_{n}": Sliding(k, F.col("x"), n) for k in sliding.KINDS for n in (1, 3)} | {"dense": Sliding("avg", F.col("x"), 3, dense=True), "before": Sliding("avg", F.col("x"), 2, dense=True, at_null=True)}
    got = {(x.ticker, x.date): x for x in sliding.add_sliding(frame, new).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    plain = {"avg": statistics.fmean, "sum": sum, "max": max, "stddev": statistics.pstdev, "median": statistics.median}
    for t, d, x in rows:
        upto = [v for at, when, v in rows if at == t and when <= d]
        known = [v for v in upto if v is not None]
        want = {f"{k}_{n}": plain[k](upto[-n:]) if len(upto) >= n and None not in upto[-n:] else None for k in plain for n in (1, 3)}
        want["dense"] = statistics.fmean(known[-3:]) if x is not None and len(known) >= 3 else None
        want["before"] = statistics.fmean(known[-2:]) if x is None and len(known) >= 2 else None
        assert {k: got[t, d][k] for k in want} == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}


@pytest.mark.parametrize("n", [1, 2, 7, 60, 252])
def test_windows_by_halves_touch_a_value_few_times(n, monkeypatch):
    values = np.random.default_rng(n).random(600)
    values[300] = np.inf
    joined = []

    def counted(kind):
        join = sliding.HALVES[kind]
        return lambda a, b: joined.append(len(a)) or join(a, b)

    for kind, plain in (("sum", np.sum), ("avg", np.mean), ("max", np.max)):
        joined.clear()
        with monkeypatch.context() as m:
            m.setitem(sliding.HALVES, kind, counted(kind))
            got = sliding._windows(values, kind, n)
        assert got == pytest.approx([plain(values[i : i + n]) for i in range(600 - n + 1)], rel=1e-14)  # infinite only where its value is
        assert sum(joined) <= 2 * n.bit_length() * 600
    assert sliding._windows(values[: n - 1], "max", n).size == 0


def test_only_named_columns_go_through_the_windows(spark):
    frame = spark.createDataFrame([("A", DAY + datetime.timedelta(days=i), float(i), "long text") for i in range(5)], "ticker string, date date, x double, s string")
    new = {"m": Sliding("max", F.col("x") + 1, 2), "a": Sliding("avg", F.col("x"), 2)}
    out = sliding.add_sliding(frame, new, ["date", "x"])
    assert out.columns == ["date", "x", "m", "a"] and "s#" not in out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].split("Window")[0]
    assert [tuple(r)[1:] for r in out.orderBy("date").collect()] == [(0.0, None, None), (1.0, 2.0, 0.5), (2.0, 3.0, 1.5), (3.0, 4.0, 2.5), (4.0, 5.0, 3.5)]


def test_features_and_cross_sections_have_no_frame_of_many_values(spark):
    bars = spark.createDataFrame([("A", DAY, *[1.0] * 6, "X")], "ticker string, date date, open double, high double, low double, close double, volume double, dollar_volume double, gics_sector string")
    plan = cross_section.normalize(features.daily_features(bars))._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and "rank(" not in plan and plan.count("MapInArrow") == 2


def test_equal_values_of_a_group_have_no_score(spark):
    rows = [(t, DAY, 0.1, "X") for t in "ABCDEFG"] + [("H", DAY, 0.7, "Y"), ("I", DAY, None, "X"), ("J", None, 0.2, "X"), ("K", DAY, 0.3, " ")]
    frame = spark.createDataFrame(rows, "ticker string, date date, x double, s string")
    got = {r.ticker: r for r in cross_section.cross_section(frame, ["x"], ["date", "s"], "c", 2, "n").collect()}
    assert [(got[t].x__c_z, got[t].x__c_pct, got[t].n) for t in "AHIJK"] == [(None, 0.5, 7), (None, None, 1), (None, None, None), (None, None, None), (None, None, None)]
