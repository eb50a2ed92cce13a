import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import features, featuresets

DAY = datetime.date(2024, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


def test_anchored_windows_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(t, day(2 * i), r.choice([None, math.nan, r.random(), r.random()]), r.random()) for t, n in (("A", 23), ("B", 8), ("C", 3), ("D", 16)) for i in range(n)]
    panel = spark.createDataFrame(r.sample(rows, len(rows)), "ticker string, date date, x double, y double")
    chosen = [(t, d) for t, d, *_ in rows if t != "D" and r.random() < 0.6]
    anchors = spark.createDataFrame([*chosen, chosen[0], ("A", day(1)), ("Z", day(0)), (None, day(0))], "ticker string, date date")
    own = {}
    for t, d, x, y in rows:
        own.setdefault(t, []).append((d, [0.0 if x is None or math.isnan(x) else x, y]))
    for n in (1, 4, 8):
        got = {(w.ticker, w.date): w.window for w in features.anchored_windows(panel, anchors, ["x", "y"], n).collect()}
        want = {}
        for t, d in set(chosen):
            upto = [x for at, x in own[t] if at <= d]
            if len(upto) >= n:
                want[t, d] = upto[-n:]
        assert got.keys() == want.keys() and len(got) > 5
        for k, window in want.items():
            assert len(got[k]) == n and all(a == pytest.approx(b, rel=1e-6) for a, b in zip(got[k], window, strict=True))
    assert features.anchored_windows(panel, anchors.limit(0), ["x", "y"], 4).count() == 0


def test_sequences_hold_contexts_their_flags_and_codes(spark):
    panel = spark.createDataFrame([("A", day(i), 0.1 * i, "XL") for i in range(5)], "ticker string, date date, log_return_1d double, sector_etf string")
    context = spark.createDataFrame([("MKT", day(i), 1.0 * i) for i in (0, 1, 2, 4)] + [("XL", day(3), None), ("XL", day(4), 9.0), ("XF", day(2), 7.0)], "ticker string, date date, log_return_1d double")
    anchors = spark.createDataFrame([("A", day(4), "Health", "no"), ("A", day(0), "Energy", "no")], "ticker string, date date, gics_sector string, window_note string")
    codes = featuresets.vocabulary(spark.createDataFrame([("Energy",), ("Tech",)], "gics_sector string"), "gics_sector")
    name = "stock_compact_market_sector_sequence"
    rows = featuresets.build_sequences(name, panel, context, anchors, "MKT", 3, {"gics_sector": codes}).collect()
    assert featuresets.sequence_features(name, {"log_return_1d"}, {"log_return_1d"}) == ["log_return_1d", "market_context_log_return_1d", "market_context_missing", "sector_context_log_return_1d", "sector_context_missing"]
    assert len(rows) == 1 and (rows[0].gics_sector_code, rows[0].window_note) == (0, "no")
    # A date without market rows, and one whose fund has no value, are missing.
    want = [[0.2, 2.0, 0.0, 0.0, 1.0], [0.3, 0.0, 1.0, 0.0, 1.0], [0.4, 4.0, 0.0, 9.0, 0.0]]
    assert all(a == pytest.approx(b) for a, b in zip(rows[0].window, want, strict=True))
    with pytest.raises(ValueError, match="needs a context"):
        featuresets.build_sequences("stock_compact_market", panel, None, anchors, "MKT", 3)


def test_runs_are_not_shuffled_again(spark):
    panel = spark.createDataFrame([("A", day(0), 1.0)], "ticker string, date date, x double")
    plan = features.anchored_windows(panel, panel.filter(F.col("x") > 0), ["x"], 3)._jdf.queryExecution().executedPlan().toString()
    after_join = plan.split("Join")[0]
    assert after_join.count("Exchange hashpartitioning(ticker") <= 1


def test_windows_of_a_sequence_set_are_not_moved(spark):
    panel = spark.createDataFrame([("A", day(i), 0.1 * i) for i in range(5)], "ticker string, date date, log_return_1d double")
    anchors = spark.createDataFrame([("A", day(3), "x", 1), ("A", day(3), "x", 1), ("A", day(4), None, 2), ("A", day(1), "y", 3)], "ticker string, date date, kind string, mark int")
    codes = {"kind": featuresets.vocabulary(anchors, "kind")}
    out = featuresets.build_sequences("stock_compact_sequence", panel, None, anchors, "MKT", 3, codes)
    got = sorted((w.date, w.kind or "", w.kind_code, w.mark, [round(x[0], 3) for x in w.window]) for w in out.collect())
    assert got == [(day(3), "x", 1, 1, [0.1, 0.2, 0.3])] * 2 + [(day(4), "", 0, 2, [0.2, 0.3, 0.4])]
    above = out._jdf.queryExecution().sparkPlan().toString().split("Generate explode")[0]
    assert not [x for x in ("Join", "Exchange", "Sort") if x in above]


def test_rows_that_are_anchors_are_dealt_once_and_marked_once(spark):
    panel = spark.createDataFrame([("A", day(i), 0.1 * i, "XL", "x" if i % 2 else None) for i in range(6)] + [("B", day(i), None, "XF", "y") for i in range(2)], "ticker string, date date, log_return_1d double, sector_etf string, kind string")
    context = spark.createDataFrame([("MKT", day(i), 1.0 * i) for i in (0, 1, 2, 4)] + [("XL", day(3), None), ("XL", day(4), math.nan), ("XF", day(2), 7.0)], "ticker string, date date, log_return_1d double")
    codes = {"kind": featuresets.vocabulary(panel, "kind")}
    name = "stock_compact_market_sector_sequence"
    mark = lambda row: F.concat_ws("|", F.transform(row, lambda x: F.round(x, 1).cast("string")))
    given = featuresets.build_sequences(name, panel, context, panel.select("ticker", "date", "kind"), "MKT", 3, codes)
    plain = featuresets.build_sequences(name, panel, context, ["kind"], "MKT", 3, codes, 8, mark)
    assert plain.columns == [*given.columns, "marks"]
    assert sorted(map(str, plain.drop("marks").collect())) == sorted(map(str, given.collect()))
    physical = plain._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    for r in plain.collect():
        assert r.marks == ["|".join(str(round(x, 1)) for x in row) for row in r.window]
    assert plain.count() == 4 and plain.filter("kind is null").first().kind_code == 0
    assert physical.count("Exchange hashpartitioning(ticker") == 1 and "SortMergeJoin" not in physical
    # The mark is made below the sort of the rows, not of each window.
    assert "transform(_x" not in physical.split("Sort [ticker")[0] and "transform(_x" in physical
