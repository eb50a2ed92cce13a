"""What the queries shuffle, sort and write, told by their plans."""

import datetime
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import cross_section, enrich, features, featuresets, labels, metrics, models, selection, sliding, splits, training, universe
from ledgerline.plans import panel_queries, panels

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
def test_windows_are_not_joined(spark):
    assert "Join" not in plan(panel_queries.QUERIES["panel_sequence_windows"](spark, SMALL))


@needs_tables
def test_larger_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(sliding, "TASK_ROWS", 500)
    rows = panels.table(spark, SMALL, "lineitem").count()
    assert panels.bars(spark, SMALL).rdd.getNumPartitions() == -(-rows // 500) > 4


def test_regression_metrics_rank_nulls_ties_and_nan_as_before(spark):
    r = random.Random(3)
    odd = lambda: r.choice([None, float("nan"), 0.0, -0.0, 1.0, r.random(), r.random(), r.random()])
    rows = [(f"d{i % 7}", f"t{i:03d}", odd(), r.choice([None, 0.5, r.random(), -r.random()])) for i in range(7 * 25)] + [("few", f"t{i}", 1.0, 2.0) for i in range(9)]
    frame = spark.createDataFrame(rows, "anchor_date string, ticker string, prediction double, actual double")
    both = F.col("prediction").isNotNull() & ~F.isnan("prediction") & F.col("actual").isNotNull()
    rank = lambda c: F.when(both, F.row_number().over(Window.partitionBy("anchor_date", both).orderBy(c, "ticker"))).cast("double")
    place, n = F.row_number().over(Window.partitionBy("anchor_date").orderBy("prediction", "ticker")), F.count(F.lit(1)).over(Window.partitionBy("anchor_date"))
    ranked = frame.withColumns({"p": rank("prediction"), "a": rank("actual"), "k": place, "n": n}).filter("n >= 10")
    daily = ranked.groupBy("anchor_date").agg(F.corr("p", "a").alias("ic"), (F.avg(F.when(F.col("k") > 20, F.col("actual"))) - F.avg(F.when(F.col("k") <= 5, F.col("actual")))).alias("spread"))
    want, got = daily.agg(F.avg("ic"), F.avg("spread")).first(), metrics.regression_metrics(frame).first()
    assert (got.rank_ic, got.top_bottom_spread) == pytest.approx(tuple(want), abs=1e-12)


def test_tasks_keep_the_first_of_each_date_only(spark):
    r = random.Random(4)
    rows = [(f"d{i % 5}", f"{r.random()}", f"t{i}") for i in range(300)]
    kept = selection._first_by_key(pa.table(dict(zip(("date", "_key", "ticker"), zip(*rows, strict=True), strict=True))).to_batches(max_chunksize=70), 3, "date")
    want = [x for d in range(5) for x in sorted(x for x in rows if x[0] == f"d{d}")[:3]]
    assert [tuple(x.values()) for b in kept for x in b.to_pylist()] == want


@needs_tables
def test_model_rows_are_made_once(spark, monkeypatch):
    _, train, test = panel_queries._model_rows(spark, SMALL)
    assert "Window" not in plan(train) + plan(test)
    written, plain = [], panel_queries.materialize
    monkeypatch.setattr(panel_queries, "materialize", lambda df: written.append(plain(df)) or written[-1])
    panel_queries.QUERIES["panel_perceptron_predictions"](spark, SMALL)
    years = written[0].agg(F.year(F.min("date")), F.year(F.max("date"))).first()
    assert "label" not in written[0].columns and years[0] >= 1995 and years[1] <= 2001


@needs_tables
def test_targets_do_not_shuffle_the_panel_by_date(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = labels.forward_targets(panels.bars(spark, SMALL), panel_queries._benchmark(spark, SMALL), [5], 5)
        assert "BroadcastHashJoin [date" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@needs_tables
def test_rejection_reasons_are_counted_without_texts_or_a_second_sort(spark):
    out = panel_queries.QUERIES["panel_rejection_reasons"](spark, SMALL)
    assert "concat_ws" not in plan(out) and "Generate explode(split" not in plan(out) and not {"gics_sector", "name", "open"} & set(re.findall(r"(\w+)#", plan(out).split("MapInArrow")[1].split("\n")[0]))
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    try:  # as with more tickers than are broadcast
        physical = panel_queries.QUERIES["panel_rejection_reasons"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Sort \[ticker", physical)) == 1 and "ShuffledHashJoin [ticker" in physical
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)


@needs_tables
def test_counted_reasons_are_those_of_the_rows(spark):
    panel = panels.holed(panels.panel(spark, SMALL))
    for rules in (panel_queries.RESEARCH, universe.CONSERVATIVE, universe.Research(enabled=False), universe.Research(common_only=False, exchanges=(), spikes=False)):
        rows = universe.add_research_universe(panel, rules, panel_queries.BENCH)
        given = Counter(x for r in rows.select("research_rejection_reasons").collect() for x in r[0].split("|") if x)
        assert {r.reason: r.rows for r in universe.reason_histogram(panel, rules, panel_queries.BENCH).collect()} == given


@needs_tables
def test_types_are_judged_once_a_ticker(spark):
    told = plan(panel_queries.QUERIES["panel_rejection_reasons"](spark, SMALL)).split("Aggregate [ticker")
    assert len(told) == 2 and "RLIKE" not in told[0] and "RLIKE" in told[1]


def shuffled(df, kind="RepartitionByExpression"):
    """The columns of the last shuffle of the rows themselves."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != kind:
        node = node.children().head()
    return sorted(node.output().apply(i).name() for i in range(node.output().size()))


@needs_tables
@pytest.mark.parametrize(("name", "columns"), [("panel_cross_section", cross_section.PANEL), ("panel_sector_cross_section", ["gics_sector", *cross_section.SECTOR])])
def test_cross_sections_shuffle_only_keys_and_what_is_ranked(spark, monkeypatch, name, columns):
    monkeypatch.setattr(sliding, "TASK_ROWS", 500)
    out = panel_queries.QUERIES[name](spark, SMALL)
    assert shuffled(out) == sorted(["ticker", "date", *columns])
    assert "Join" not in plan(out).split("MapInArrow")[1]  # sectors are looked up before the windows
    assert out.rdd.getNumPartitions() == -(-panels.items(spark, SMALL) // 500)


def test_a_cross_section_casts_what_is_no_double_and_keeps_what_is_named(spark):
    frame = spark.createDataFrame([("A", "d", 1, 2.0), ("B", "d", 3, None), ("C", "d", 3, 4.0), ("D", "", 9, 9.0)], "ticker string, date string, x int, y double")
    out = cross_section.cross_sections(frame, [cross_section.Section(["x", "y"], ["date"], "s", 2, "n")], ["ticker", "x"])
    assert out.columns == ["ticker", "x", "x__s_z", "x__s_pct", "y__s_z", "y__s_pct", "n"]
    got = {r.ticker: (r.x, r.x__s_pct, r.y__s_pct, r.n) for r in out.collect()}
    assert got == {"A": (1, 0.0, 0.0, 2), "B": (3, 0.75, None, 3), "C": (3, 0.75, 1.0, 2), "D": (9, None, None, None)}


@needs_tables
def test_named_features_are_those_of_all(spark):
    bars = panels.holed(panels.bars(spark, SMALL))
    whole = features.daily_features(bars)
    for wanted in (["date", "ticker", "price_vs_sma_20d", "has_60d_history", "open"], ["ticker", "date", "momentum_60d"], ["ticker", "date", "volume_zscore_20d", "sma_close_60d", "gap_pct", "dollar_volume_ratio_5d"]):
        part = features.daily_features(bars, wanted)
        assert part.columns == wanted and sorted(map(str, part.collect())) == sorted(map(str, whole.select(*wanted).collect()))
    assert "MapInArrow" not in plan(features.daily_features(bars, ["ticker", "date", "momentum_60d"]))


@needs_tables
def test_a_lean_set_moves_its_rows_once_by_date_and_once_by_ticker(spark, monkeypatch):
    monkeypatch.setattr(sliding, "TASK_ROWS", 500)
    out = panel_queries.QUERIES["panel_feature_set_lean"](spark, SMALL)
    # The set's own windows, the as-of join's and the contexts' take one shuffle and no join but of broadcast contexts.
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and physical.count("Exchange hashpartitioning(date") == 1
    above = physical.split("Union")[0]
    assert above.count("Exchange hashpartitioning") == 1 and above.count("Sort [ticker") == 1
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    sent = re.search(r"RepartitionByExpression \[date.*\n.*Project \[(.*)\]", plan(panel_queries.QUERIES["panel_feature_set_lean"](spark, SMALL))).group(1)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(re.split(r", (?![^(]*\))", sent)) < 10 and "volume_ratio" not in sent
    assert out.rdd.getNumPartitions() == -(-panels.items(spark, SMALL) // 500)


@needs_tables
def test_a_set_without_anchors_is_that_of_all_rows(spark):
    rows = features.daily_features(panels.bars(spark, SMALL)).withColumn("sector_etf", F.lit("ASIA"))
    around = features.daily_features(panels.context(spark, SMALL))
    given = featuresets.build("stock_compact_market_sector", rows, around, rows.select("ticker", "date"), "MKT", 5)
    plain = featuresets.build("stock_compact_market_sector", rows, around, None, "MKT", 5)
    assert set(plain.columns) == set(given.columns)
    assert sorted(map(str, plain.select(*given.columns).collect())) == sorted(map(str, given.collect()))
    some = ["stock_gap_pct__std60", "stock_true_range_pct__last"]
    part = featuresets.build("stock_compact", rows, None, None, "MKT", 5, some)
    assert set(part.columns) == {"ticker", "date", *some}
    assert sorted(map(str, part.select("ticker", "date", *some).collect())) == sorted(map(str, given.select("ticker", "date", *some).collect()))
    with pytest.raises(ValueError, match="not in stock_compact"):
        featuresets.build("stock_compact", rows, None, None, "MKT", 5, ["stock_close__last"])


def test_as_of_of_other_types_and_null_keys_is_as_before(spark):
    left = spark.createDataFrame([("A", datetime.date(2024, 1, 2), 1.0), (None, datetime.date(2024, 1, 5), 2.0), ("B", None, 3.0)], "k string, d date, x double")
    right = spark.createDataFrame([("A", "2024-01-02", None, 1), ("A", "2024-01-02", 5.0, 0), ("A", None, 9.0, 9), (None, "2024-01-01", 7.0, 1), ("B", "2024-01-01", 8.0, 1)], "k string, at string, y double, tie int")
    for r in (right.withColumn("at", F.col("at").cast("date")), right.withColumn("at", F.col("at").cast("timestamp"))):
        got = enrich.as_of(left, r, "k", "d", "at", ["tie"])
        assert got.columns == ["k", "d", "x", "at", "y", "tie"] and got.schema["d"].dataType == left.schema["d"].dataType
        assert {(v.k, v.x): (v.y, v.tie) for v in got.collect()} == {("A", 1.0): (None, 1), (None, 2.0): (7.0, 1), ("B", 3.0): (None, None)}


@needs_tables
def test_a_feature_set_is_dealt_by_ticker_once_after_its_features(spark):
    physical = panel_queries.QUERIES["panel_feature_set"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    own = physical.split("MapInArrow task(ticker")[1]  # between the set's windows and those of the features
    assert own.count("Exchange hashpartitioning(ticker") == 1 and "Join" not in own


@needs_tables
def test_baselines_go_through_written_rows(spark, monkeypatch):
    written, plain = [], panel_queries.materialize
    monkeypatch.setattr(panel_queries, "materialize", lambda df: written.append(plain(df)) or written[-1])
    out = panel_queries.QUERIES["panel_baseline_predictions"](spark, SMALL)
    assert len(written) == 1 and "Window" not in plan(out)
    assert out.count() == panels.bars(spark, SMALL).filter("date >= '1998-01-01'").count()  # with and without a target


@needs_tables
def test_the_training_board_deals_written_rows(spark, monkeypatch):
    class Reached(Exception):
        pass

    def train(rows, spans, *_):
        raise Reached(plan(rows), rows.columns, spans)

    monkeypatch.setattr(panel_queries.training, "train_walk_forward", train)
    with pytest.raises(Reached) as e:
        panel_queries.QUERIES["panel_training_board"](spark, SMALL)
    made, columns, spans = e.value.args
    assert "Window" not in made and "MapInArrow" not in made
    assert set(columns) == {"ticker", "date", "rolling_return_20d", "volume_ratio_20d", "y"}
    assert spans == splits.walk_forward(splits.distinct_dates(panel_queries._model_rows(spark, SMALL, all_dates=True)[1]), panel_queries.BOARD_RULES)


def test_metrics_by_split_equal_those_of_each_and_write_nothing(spark, monkeypatch):
    r = random.Random(5)
    odd = lambda: r.choice([None, float("nan"), 0.0, -0.0, 1.0, r.random(), -r.random(), r.random()])
    rows = [(f"d{i % 9}", r.choice([None, f"t{i:03d}", f"t{i:03d}"]), odd(), r.choice([None, 0.5, -r.random()]), ("val", "oos")[i % 9 > 3]) for i in range(9 * 25)]
    rows += rows[:40] + [(None, f"t{i}", 1.0, 2.0 + i, "val") for i in range(12)]
    frame = spark.createDataFrame(rows, "date string, ticker string, prediction double, actual double, split string").coalesce(1)
    each = {name: metrics.regression_metrics(frame.filter(F.col("split") == name), "date").first().asDict() for name in ("val", "oos", "none")}
    monkeypatch.setattr(metrics, "materialize", None)  # predictions are written already
    got = training._measure(frame, training.regression_recipe("ridge"), ["val", "oos", "none"], "date", "ticker", None)
    assert got.columns == [*each["val"], "split"]
    found = {x["split"]: x.asDict() for x in got.collect()}
    assert len(found) == 3 and found["none"]["row_count"] == 0 and found["none"]["rmse"] is None
    for name, want in each.items():
        assert {c: found[name][c] for c in want} == pytest.approx(want, nan_ok=True)


def test_a_ridge_fit_goes_through_its_rows_three_times(spark):
    """For the scales and the target's deviation, for the equations, and for Spark's own summary."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    r = random.Random(6)
    rows = [(r.choice([None, float("nan"), r.random()]), r.random(), r.choice([None, r.random(), r.random()])) for _ in range(300)]
    frame = spark.createDataFrame(rows, "a double, b double, y double").filter("a IS NULL OR NOT isnan(a)").coalesce(1)
    n = frame.count()
    model = models.fit_regressor("ridge", frame.mapInArrow(count, frame.schema), ["a", "b"], "y")
    assert seen.value == 3 * n
    known = [(a or 0.0, b, y) for a, b, y in frame.collect() if y is not None]
    x, y = np.array([k[:2] for k in known]), np.array([k[2] for k in known])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y - y.mean()))  # a penalty of 10 on the summed loss
    got = [p.prediction for p in model.transform(frame.filter("y IS NOT NULL")).collect()]
    assert np.allclose(got, z @ w + y.mean(), atol=1e-6)
