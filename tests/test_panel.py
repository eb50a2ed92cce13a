import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scalars
from ledgerline.operators import cross_section, enrich, features, featuresets, labels, metrics, models, selection, signals, splits, universe, upsert

DAY = dt.date(2024, 1, 1)


def bars(spark, rows):
    """rows: ticker, day, open, high, low, close, volume."""
    schema = "ticker string, date date, open double, high double, low double, close double, volume double, dollar_volume double"
    return spark.createDataFrame([(t, DAY + dt.timedelta(d), o, h, lo, c, v, None if c is None or v is None else c * v) for t, d, o, h, lo, c, v in rows], schema)


def random_bars(seed, n=90, holes=0.2):
    r = random.Random(seed)
    some = lambda x: None if r.random() < holes else x
    return [("A", d, some(r.uniform(5, 15)), r.uniform(15, 20), r.uniform(1, 5), some(r.uniform(5, 15)), some(float(r.randint(1, 900)))) for d in range(n)]


def test_moves_of_one_day(spark):
    row = features.daily_features(bars(spark, [("A", 0, 10.0, 10.0, 10.0, 10.0, 5.0), ("A", 1, 10.5, 11.0, 10.0, 11.0, 6.0)])).orderBy("date").collect()[1]
    assert row.return_1d == pytest.approx(0.1) and row.gap_pct == pytest.approx(0.05)
    assert row.close_location == 1.0 and row.true_range_pct == pytest.approx(0.1)


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_windows_match_a_queue(spark, seed):
    rows = random_bars(seed)
    got = features.daily_features(bars(spark, rows)).orderBy("date").collect()
    closes, returns, volumes = [], [], []
    for row, (_, _, _, _, _, close, volume) in zip(got, rows, strict=True):
        ret = close / closes[-1] - 1 if closes and close is not None else None
        same = lambda a, b: (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))
        assert same(row.return_1d, ret)
        assert same(row.rolling_return_5d, close / closes[-4] - 1 if close is not None and len(closes) >= 4 else None)
        assert same(row.rolling_vol_20d, statistics.pstdev([*returns[-19:], ret]) if ret is not None and len(returns) >= 19 else None)
        assert same(row.rolling_avg_volume_20d, statistics.mean([*volumes[-19:], volume]) if volume is not None and len(volumes) >= 19 else None)
        assert same(row.sma_close_20d, statistics.mean([*closes[-19:], *([close] if close is not None else [])]) if len(closes) >= 19 else None)
        assert row.has_20d_history == (len(closes) >= 19)
        closes += [close] * (close is not None)
        returns += [ret] * (ret is not None)
        volumes += [volume] * (volume is not None)


def test_features_do_not_look_ahead(spark):
    rows = random_bars(3)
    changed = [(t, d, *(x if d <= 60 or x is None else x * 3 for x in rest)) for t, d, *rest in rows]
    cut = F.col("date") <= DAY + dt.timedelta(60)
    a, b = (features.daily_features(bars(spark, x)).filter(cut).orderBy("date").collect() for x in (rows, changed))
    assert a == b


def test_percentile_ties_and_sector_minimum(spark):
    three = spark.createDataFrame([(DAY, "a", 1.0), (DAY, "b", 1.0), (DAY, "c", 3.0), (DAY, "d", None)], "date date, ticker string, x double")
    got = {r.ticker: r for r in cross_section.cross_section(three, ["x"], ["date"], "cs", 2, "n").collect()}
    assert [got[t].x__cs_pct for t in "abcd"] == [0.25, 0.25, 1.0, None] and got["a"].n == 3 and got["d"].n is None
    sectors = spark.createDataFrame([(DAY, f"t{i}", "S" if i < 5 else "T" if i < 9 else "", float(i)) for i in range(12)], "date date, ticker string, gics_sector string, x double")
    got = {r.ticker: r for r in cross_section.cross_section(sectors, ["x"], ["date", "gics_sector"], "s", 5, "n").collect()}
    assert got["t0"].x__s_pct == 0 and got["t4"].x__s_pct == 1 and got["t6"].x__s_pct is None and got["t6"].n == 4 and got["t10"].n is None


def test_as_of_keeps_rows_and_breaks_ties(spark):
    left = spark.createDataFrame([("A", dt.date(2024, 4, 24)), ("A", dt.date(2024, 4, 25)), ("B", dt.date(2024, 4, 25))], "ticker string, date date")
    day = dt.date(2024, 4, 25)
    right = spark.createDataFrame(
        [("A", day, dt.date(2024, 3, 31), "quarterly", 1.0, 5.0), ("A", day, dt.date(2024, 3, 31), "yearly", None, 6.0), ("A", day, dt.date(2023, 12, 31), "yearly", 9.0, 7.0)],
        "ticker string, availability_date date, source_period_end date, source_frequency string, x double, y double",
    )
    got = sorted((r.ticker, r.date.day, r.fundamental_missing, r.x, r.y) for r in enrich.add_fundamentals(left, right).collect())
    assert got == [("A", 24, 1.0, None, None), ("A", 25, 0.0, None, 6.0), ("B", 25, 1.0, None, None)]


def test_sentiment_lags_one_row(spark):
    panel = spark.createDataFrame([("A", DAY + dt.timedelta(i)) for i in range(3)], "ticker string, date date")
    raw = spark.createDataFrame([("A", DAY, 3.0, 0.5), ("A", DAY + dt.timedelta(1), 1.0, -0.5)], "ticker string, date date, sentiment_count_raw double, sentiment_normalized_raw double")
    got = enrich.add_sentiment(panel, raw).orderBy("date").collect()
    assert [r.sentiment_count for r in got] == [0.0, 3.0, 1.0] and [r.sentiment_missing for r in got] == [1.0, 0.0, 0.0]
    assert got[2].sentiment_count_5d == 4.0 and got[2].sentiment_weighted_20d == 1.0


def test_filings_and_sentiment_payloads(spark):
    good = '{"Financials": {"Income_Statement": {"quarterly": {"2024-03-31": {"date": "2024-03-31", "filing_date": "2024-04-25", "totalRevenue": "200", "netIncome": "NA", "netIncomeApplicableToCommonShares": "20"}, "2023-12-31": {"date": "2023-12-31", "totalRevenue": "1"}}}, "Balance_Sheet": {"quarterly": {"2024-03-31": {"date": "2024-03-31", "filing_date": "2024-05-01", "totalAssets": "400"}}}}}'
    rows = spark.createDataFrame([("aaa.us", good), ("BAD.US", "{oops")], "symbol string, payload string")
    (row,) = enrich.parse_filings(rows).collect()
    assert (row.ticker, row.availability_date, row.fundamental_revenue, row.fundamental_net_income) == ("AAA", dt.date(2024, 4, 25), 200.0, 20.0)
    assert row.fundamental_net_margin == pytest.approx(0.1) and row.fundamental_roa == pytest.approx(0.05)
    assert enrich.parse_filings(rows, latest_statement=True).first().availability_date == dt.date(2024, 5, 1)
    said = spark.createDataFrame([('{"AAA.US": [{"date": "2024-01-02", "count": 3, "normalized": 0.4}, {"count": 1}]}',)], "payload string")
    assert [tuple(r) for r in enrich.parse_sentiment(said).collect()] == [("AAA", dt.date(2024, 1, 2), 3.0, 0.4)]


@pytest.mark.parametrize(
    ("event", "paths", "expected"),
    [
        (labels.ANYTIME, [[0.01, 0.06, -0.2, 0.0, -0.1], [0.06, 0.01, 0.02, 0.01, 0.02], [0.01, 0.02, 0.0, 0.0, 0.01], [None] * 5], [1.0, 1.0, 0.0, 0.0]),
        (labels.SUSTAINED, [[0.01, 0.06, -0.2, 0.0, -0.1], [0.06, 0.01, 0.02, 0.01, 0.02], [0.01, 0.02, 0.0, 0.0, 0.01], [0.06, 0.01, 0.02, 0.01, None]], [0.0, 1.0, 0.0, 0.0]),
        (labels.PATH, [[0.01, 0.05], [0.06, -0.05], [0.01, -0.01], [-0.05, 0.0], [0.06, None]], [2.0, 0.0, 1.0, 0.0, None]),
    ],
)
def test_labels(spark, event, paths, expected):
    rows = spark.createDataFrame(list(enumerate(paths)), "i int, path array<double>")
    got = rows.select("i", labels.path_label(F.col("path"), event, 0.05).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == expected


def test_episode_index(spark):
    rows = [("A", i, 1.0, 1.0, 1.0, 1.0 + i, 1.0) for i in range(5)] + [("SPY", i, 1.0, 1.0, 1.0, 2.0, 1.0) for i in range(5)]
    panel = bars(spark, rows)
    got = labels.episode_index(panel, panel.filter("ticker = 'SPY'"), 3, 1).orderBy("anchor_date").collect()
    assert len(got) == 2 and got[0].anchor_date == DAY + dt.timedelta(2) and got[0].window_start_date == DAY
    assert got[0].target_return == pytest.approx(4 / 3 - 1) == got[0].market_adjusted_target_return


def universe_panel(spark):
    good = [(260 + i) / 10 for i in range(260)]
    rows = []
    for t, scale, kind, exchange in (("GOOD", 1, "Common Stock", "NYSE"), ("ETFX", 1, "ETF", "NYSE"), ("OTCX", 1, "Common Stock", "OTC"), ("CHEAP", 0.01, "Common Stock", "NASDAQ"), ("AMEXX", 1, "Common Stock", "NYSE MKT"), ("SPY", 1, "Common Stock", "NYSE")):
        rows += [(t, d, c * scale, c * scale * 1.01, c * scale * 0.99, c * scale, 1e6 / scale, kind, exchange) for d, c in enumerate(good)]
    base = bars(spark, [r[:7] for r in rows])
    more = spark.createDataFrame(list({(r[0], r[7], r[8]) for r in rows}), "ticker string, type string, exchange string")
    return base.join(more, "ticker")


def test_research_universe_reasons(spark):
    last = universe.add_research_universe(universe_panel(spark)).filter(F.col("date") == DAY + dt.timedelta(259))
    got = {r.ticker: r for r in last.collect()}
    assert got["GOOD"].research_universe_ok and got["AMEXX"].research_universe_ok and got["GOOD"].research_rejection_reasons == ""
    assert got["ETFX"].research_rejection_reasons == "REJECTED_INVALID_SECURITY_TYPE" and got["OTCX"].research_primary_rejection_reason == "REJECTED_UNSUPPORTED_EXCHANGE"
    assert got["CHEAP"].research_rejection_reasons.startswith("REJECTED_LOW_PRICE")
    assert not got["SPY"].research_universe_ok and got["SPY"].research_rejection_reasons == ""
    off = universe.add_research_universe(universe_panel(spark), universe.Research(enabled=False)).filter("NOT research_universe_ok")
    assert off.isEmpty()


def test_eligibility(spark):
    got = {r.ticker: r for r in universe.add_eligibility(universe_panel(spark)).filter(F.col("date") == DAY + dt.timedelta(259)).collect()}
    assert got["GOOD"].episode_eligible and not got["ETFX"].episode_eligible and not got["OTCX"].eligibility_exchange_ok and not got["SPY"].episode_eligible
    early = universe.add_eligibility(universe_panel(spark)).filter("ticker = 'GOOD' AND window_row_count = 59").first()
    assert early.eligibility_valid_ohlcv_rows is None and not early.eligibility_history_ok
    with pytest.raises(ValueError):
        universe.Eligibility(valid_rows=61)


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert get(scalars.epoch_ms_date(lit(1704153600000))) == dt.date(2024, 1, 2)
    assert [get(scalars.lenient_double(lit(x))) for x in ("1.5", "NA", "", "x", "NaN", "inf")] == [1.5, None, None, None, None, None]
    assert [get(scalars.lenient_bool(lit(x))) for x in ("Yes", "0", "maybe")] == [True, False, None]
    assert get(scalars.ratio(lit(1.0), lit(0.0))) is None and get(scalars.log1p_guarded(lit(-0.5))) is None
    assert get(scalars.vendor_symbol(lit("abc"))) == "ABC.US" and get(scalars.own_ticker(lit("abc.us"))) == "ABC"
    assert [get(scalars.other_security(lit(c), lit(n))) for c, n in (("AB-WS", "x"), ("ABCDW", "x"), ("AB", "Acme Warrants"), ("AB", "Acme Inc"), ("BRK-B", "x"))] == [True, True, True, False, False]
    assert all(get(scalars.other_security(lit(c), lit("x"))) for c in ("ABC-PRAA", "ABC-WTX", "BR1KW", "AB.CU")) and not get(scalars.other_security(lit("A-BCDW"), lit("x")))
    listed = lambda own, asked, **k: get(scalars.listed_exchange(lit(own).cast("string"), lit(asked), **k))
    assert [listed(*x) for x in (("NYSE MKT", "AMEX"), ("NYSE", "AMEX"), (None, "nyse"), ("", "US"), ("XETRA", "US"), ("PINK", "US"), ("ARCA", "NYSE"))] == ["AMEX", None, "NYSE", "US", "XETRA", None, None] and listed("PINK", "US", with_otc=True) == "PINK"
    assert [get(scalars.rank_bucket(lit(float(p)))) for p in (3, 4, 10, 15, 30, 31)] == ["TOP_3_PERCENT", "TOP_5_PERCENT", "TOP_DECILE", "TOP_20_PERCENT", "TOP_30_PERCENT", "BELOW_TOP_30_PERCENT"]
    day = lambda s: lit(s).cast("date")
    assert [get(scalars.business_days_held(day(a), day(b))) for a, b in (("2024-01-05", "2024-01-05"), ("2024-01-05", "2024-01-08"), ("2024-01-01", "2024-01-15"))] == [1, 2, 11]
    assert get(scalars.argmax(F.array(lit(0.3), lit(0.5), lit(0.5)))) == 1 and sum(get(scalars.softmax(F.array(lit(1.0), lit(900.0))))) == 1.0
    assert get(scalars.test_symbol(lit("ZVZZT"), lit(None))) and get(scalars.test_symbol(lit("A"), lit("Test Stock"))) and not get(scalars.test_symbol(lit("A"), lit("Testing Inc")))


def test_merge_is_idempotent_and_incoming_wins(spark):
    base = spark.createDataFrame([("A", 1, "old"), ("B", 1, "old")], "k string, d int, v string")
    new = spark.createDataFrame([("B", 1, "new", 5), ("C", 1, "new", 6)], "k string, d int, v string, w int")
    once = upsert.merge(base, new, ["k", "d"], None)
    assert sorted((r.k, r.v) for r in once.collect()) == [("A", "old"), ("B", "new"), ("C", "new")]
    assert sorted(map(tuple, upsert.merge(once, new, ["k", "d"], None).select(*once.columns).collect())) == sorted(map(tuple, once.collect()))


def test_the_last_to_arrive_wins(spark, tmp_path):
    base = spark.createDataFrame([("A", 1, 5.0), ("B", 2, 5.0)], "k string, d int, v double")
    new = spark.createDataFrame([("A", 1, 9.0, 1), ("A", 1, 7.0, 2), ("C", 1, 3.0, 3)], "k string, d int, v double, at int")
    want = [("A", 1, 7.0), ("B", 2, 5.0), ("C", 1, 3.0)]
    assert sorted(map(tuple, upsert.merge(base, new, ["k", "d"], "at").collect())) == want
    path = str(tmp_path / "t")
    upsert.merge_into(spark, path, base, ["k", "d"], "d", None)
    upsert.merge_into(spark, path, new, ["k", "d"], "d", "at")
    assert sorted((r.k, r.d, r.v) for r in spark.read.parquet(path).collect()) == want and not any(x.name.endswith("_merge") for x in tmp_path.iterdir())


def test_increments_beside_a_table(spark, tmp_path):
    path, folder, archive = (str(tmp_path / x) for x in ("t", "more", "old"))
    upsert.merge_into(spark, path, spark.createDataFrame([("A", 1, 5.0), ("B", 2, 5.0)], "k string, d int, v double"), ["k", "d"], "d", None)
    for v in (6.0, 4.0):
        upsert.add_increment(spark.createDataFrame([("A", 1, v), ("N", 3, v)], "k string, d int, v double"), folder)
    want = [("A", 1, 4.0), ("B", 2, 5.0), ("N", 3, 4.0)]
    key = lambda df: sorted((r.k, r.d, r.v) for r in df.collect())
    assert key(upsert.with_increments(spark, spark.read.parquet(path), folder, ["k", "d"])) == want
    upsert.consolidate(spark, path, folder, ["k", "d"], "d", archive)
    upsert.consolidate(spark, path, folder, ["k", "d"], "d", archive)  # nothing is left to do
    assert key(upsert.with_increments(spark, spark.read.parquet(path), folder, ["k", "d"])) == want
    assert key(spark.read.parquet(path)) == want and spark.read.parquet(archive).count() == 4 and not list((tmp_path / "more").glob("*.parquet"))


def test_bounded_state_gives_the_same_windows(spark):
    rows = [("A", d, 10.0 + d % 7, 20.0, 1.0, 10.0 + d % 5, 5.0 + d) for d in range(150)]
    whole = features.daily_features(bars(spark, rows)).filter(F.col("date") >= DAY + dt.timedelta(148)).orderBy("date")
    state = upsert.state_rows(bars(spark, rows[:1]).limit(0), bars(spark, rows[:148]), 125)
    after = upsert.state_rows(state, bars(spark, rows[148:]), 125)
    assert state.count() == after.count() == 125
    same = features.daily_features(after).filter(F.col("date") >= DAY + dt.timedelta(148)).orderBy("date")
    assert same.drop("has_60d_history").collect() == whole.drop("has_60d_history").collect()


def test_merge_into_and_stream(spark, tmp_path):
    from ledgerline.streaming.ingest import stream_bars

    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    first = bars(spark, [("A", d, 1.0, 1.0, 1.0, 1.0, 1.0) for d in range(40)])
    first.coalesce(1).write.parquet(source)
    stream_bars(spark, source, first.schema, table, str(tmp_path / "c")).awaitTermination()
    again = bars(spark, [("A", 39, 1.0, 1.0, 1.0, 7.0, 1.0), ("A", 40, 1.0, 1.0, 1.0, 8.0, 1.0), ("A", 2, 1.0, 1.0, 1.0, 9.0, 1.0)])
    again.coalesce(1).write.mode("append").parquet(source)
    stream_bars(spark, source, first.schema, table, str(tmp_path / "c")).awaitTermination()
    got = {(r.date - DAY).days: r.close for r in spark.read.parquet(table).collect()}
    assert len(got) == 41 and got[39] == 7.0 and got[40] == 8.0 and got[2] == 9.0
    assert upsert.fetch_start(None, DAY, 7) == DAY and upsert.fetch_start(DAY, DAY, 0) == DAY + dt.timedelta(1) and upsert.fetch_start(DAY, DAY, 7) == DAY - dt.timedelta(6)


def test_splits(spark):
    dates = [DAY + dt.timedelta(i) for i in range(400)]
    each = lambda spans: [(s.fold, s.split, d) for s in spans for d in dates if s.first <= d <= s.last]
    folds = each(splits.walk_forward(dates, splits.FoldRules(252, 21, 21, 20)))
    panel = spark.createDataFrame([(d,) for d in dates] * 2, "date date")
    got = splits.split_rows(panel, splits.walk_forward(dates)).collect()
    assert sorted((r.fold_id, r.split, r.date) for r in got) == sorted(each(splits.walk_forward(dates)) * 2)
    zero = {s: [d for f, k, d in folds if f == 0 and k == s] for s in ("train", "val", "oos")}
    assert [len(zero[s]) for s in ("train", "val", "oos")] == [252, 21, 21]
    assert (zero["oos"][0] - zero["val"][-1]).days == 21 and max(f for f, _, _ in folds) == 4
    apart = [d for f, k, d in each(splits.walk_forward(dates, purge_validation=True)) if f == 0 and k == "train"]
    assert (zero["val"][0] - apart[-1]).days == 21
    assert splits.last_fold(dates)[-1].last == dates[-1] and splits.FoldRules(purge=5).checked(20).purge == 20
    assert [sum(k == s for _, k, _ in each(splits.holdout(dates))) for s in ("train", "val", "test")] == [280, 60, 60]
    assert sum(k == "refit" for _, k, _ in each(splits.final_fit(dates))) == 400
    with pytest.raises(ValueError):
        splits.holdout(dates[:2])


def test_metrics_against_plain_python(spark):
    r = random.Random(5)
    rows = [(DAY + dt.timedelta(i // 12), f"t{i}", round(r.random(), 1), r.randint(0, 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "anchor_date date, ticker string, score double, positive int")
    got = metrics.ranking_areas(df).first()
    pos, neg = [s for *_, s, p in rows if p], [s for *_, s, p in rows if not p]
    assert got.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    expected, before = 0.0, 0.0
    for t in sorted({s for *_, s, _ in rows}, reverse=True):
        hits = sum(s >= t for s in pos)
        expected += (hits / len(pos) - before) * hits / sum(s >= t for *_, s, _ in rows)
        before = hits / len(pos)
    assert got.pr_auc == pytest.approx(expected)
    one = metrics.ranking_areas(df.withColumn("positive", F.lit(1))).first()
    assert one.roc_auc is None
    skewed = metrics.ranking_areas(df.withColumn("score", F.exp(F.col("score") * 30))).first()
    assert (skewed.roc_auc, skewed.pr_auc) == (pytest.approx(got.roc_auc), pytest.approx(got.pr_auc))


def test_signals_and_reviews(spark):
    preds = spark.createDataFrame([(m, "f", f"T{i:03}", DAY, 100.0 + i, 1.0 - i / 100) for m in ("a", "b") for i in range(100)], "model_name string, feature_set string, ticker string, anchor_date date, anchor_close double, prediction_score double")
    out = {r.ticker: r for r in signals.ranked_signals(preds, "2024-01-02").collect()}
    assert out["T000"].suggested_action == "ENTRY CANDIDATE" and out["T000"].agreement_status == "VERY STRONG (2/2 top-decile)" and out["T000"].reason == "Top 1.00% with 2/2 models in top decile"
    assert out["T007"].suggested_action == "WATCHLIST" and out["T050"].suggested_action == "IGNORE"
    ledger = spark.createDataFrame(
        [("t000", DAY - dt.timedelta(3), 100.0, 1, "OPEN"), ("T001", DAY - dt.timedelta(3), 95.0, 1, "OPEN"), ("T002", DAY - dt.timedelta(3), 110.0, 1, "OPEN"), ("T003", DAY - dt.timedelta(60), 103.0, 1, "OPEN"), ("T040", DAY, 140.0, 1, "OPEN"), ("T099", DAY, 5.0, 1, "SOLD"), ("NONE", DAY, 5.0, 1, "OPEN")],
        "ticker string, entry_date date, entry_price double, shares int, current_status string",
    )
    review = {r.ticker: r.review_action for r in signals.review_positions(ledger, signals.ranked_signals(preds, "x"), "x").collect()}
    assert review == {"T000": "HOLD", "T001": "SELL - TARGET", "T002": "SELL - STOP", "T003": "SELL - TIME", "T040": "STRONG REVIEW", "NONE": "REVIEW"}
    with pytest.raises(ValueError):
        signals.review_positions(ledger.drop("shares"), signals.ranked_signals(preds, "x"), "x")


def test_ensemble_ranks_by_twelve_digits_and_percents_as_printf(spark):
    rows = [("m1", "s", "B", 0.1, 1.0), ("m2", "s", "B", 0.2, 1.0), ("m1", "s", "A", 0.3, 1.0), ("m2", "s", "A", 0.0, 1.0)]
    frame = lambda x: spark.createDataFrame(x, "model_name string, feature_set string, ticker string, prediction_score double, anchor_close double").withColumn("anchor_date", F.lit(dt.date(2024, 1, 1)))
    out = {r.ticker: r.ensemble_rank for r in signals.ranked_signals(frame(rows), "x").collect()}
    assert out == {"A": 1, "B": 2}  # 0.1 + 0.2 is more than 0.3 + 0.0 in its last bit only
    many = [(m, "s", f"T{i:04}", -float(i), 1.0) for m in ("m1", "m2") for i in range(800)]
    told = [r for r in signals.ranked_signals(frame(many), "x").collect() if r.suggested_action == "ENTRY CANDIDATE"]
    assert len(told) == 40
    for r in told:
        assert r.reason == f"Top {r.ensemble_percentile:.2f}% with 2/2 models in top decile"


def test_feature_sets(spark):
    every = {*featuresets.BASE, *featuresets.LEAN_RELATIVE, *featuresets.LEAN_SECTOR, *featuresets.COMPACT_RELATIVE, *featuresets.COMPACT_SECTOR, *featuresets.FUNDAMENTAL, *featuresets.SENTIMENT}
    assert featuresets.stock_features("stock_only", every) == featuresets.BASE and len(featuresets.BASE) == 29 and len(featuresets.COMPACT) == 21
    assert set(featuresets.SENTIMENT) <= set(featuresets.stock_features("stock_only_sentiment", every))
    assert featuresets.sequence_features("stock_relative_market_compact_sequence", every, set(featuresets.CONTEXT))[-1] == "market_context_missing"
    featuresets.check_inputs(["stock_return_1d__last"])
    for bad in ("stock_close__mean60", "market_context_volume__last", "ticker"):
        with pytest.raises(ValueError):
            featuresets.check_inputs([bad])
    with pytest.raises(ValueError):
        featuresets.aligned(spark.range(1), ["absent"])


def test_models(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i + 1, float(i % 2)) for i in range(40)], "a double, b double, y double, label double")
    fitted = models.fit_regressor("elastic_net", rows, ["a", "b"], "y").transform(rows)
    assert fitted.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1.0
    same = models.fit_classifier("logistic", rows.filter("label = 1"), ["a", "b"], "label", 2)
    assert same.transform(rows).first().probabilities == [0.0, 1.0]


@pytest.mark.parametrize("kind", ["logistic", "elastic_net_logistic", "forest", "boosted_trees", "perceptron"])
def test_classifiers_learn_a_threshold(spark, kind, tmp_path):
    rows = spark.createDataFrame([(float(i), float(i % 3) if i % 5 else None, float(i >= 30)) for i in range(60)], "a double, b double, label double")
    fitted = models.fit_classifier(kind, rows, ["a", "b"], "label", 2)
    out = fitted.transform(rows).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in out)
    assert sum((r.probabilities[1] > 0.5) == bool(r.label) for r in out) >= 54
    fitted.save(str(tmp_path / "m"))
    again = models.Fitted.load(str(tmp_path / "m"))
    assert again.columns == ("a", "b") and [r.probabilities for r in again.transform(rows).collect()] == [r.probabilities for r in out]
    with pytest.raises(ValueError):
        again.transform(rows.drop("b"))


@pytest.mark.parametrize("kind", ["ridge", "elastic_net", "boosted_trees"])
def test_regressors(spark, kind):
    import numpy as np

    r = random.Random(8)
    data = [(r.uniform(0, 50), r.uniform(-1, 1), r.uniform(0, 1)) for _ in range(80)]
    rows = spark.createDataFrame([(a, b, 2 * a - 3 * b + e) for a, b, e in data], "a double, b double, y double")
    out = models.fit_regressor(kind, rows, ["a", "b"], "y").transform(rows).orderBy("a").collect()
    error = statistics.mean(abs(x.prediction - x.y) for x in out)
    assert error < {"ridge": 4, "elastic_net": 2, "boosted_trees": 12}[kind] < statistics.pstdev([x.y for x in out])
    if kind == "ridge":  # the normal equations, with population deviations
        x, y = np.array([[p.a, p.b] for p in out]), np.array([p.y for p in out])
        z = (x - x.mean(0)) / x.std(0)
        weights = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y - y.mean()))
        assert [p.prediction for p in out] == pytest.approx((y.mean() + z @ weights).tolist(), abs=1e-6)


def test_selection_of_rows(spark):
    panel = bars(spark, [(t, d, 1.0, 1.0, 1.0, 1.0 + d, 1.0) for t, n in (("A", 5), ("B", 9), ("C", 9)) for d in range(n)])
    assert {r.ticker for r in selection.latest_rows(panel, 2).collect()} == {"B", "C"} and selection.tail_rows(panel, 2).count() == 6
    assert {r.ticker for r in selection.latest_windows(panel, 6).collect()} == {"B", "C"}
    numbered = panel.withColumn("window_row_count", F.lit(1))
    assert selection.hash_sample(numbered, 1).count() == 9 and sorted(selection.hash_sample(numbered, 1).collect()) == sorted(selection.hash_sample(numbered.repartition(3), 1).collect())
    assert [r.date.day for r in selection.weekdays(spark, "2024-01-05", "2024-01-09").collect()] == [5, 8, 9]


def test_features_only_if_absent(spark):
    panel = bars(spark, [("A", d, 10.0 + d, 12.0 + d, 9.0 + d, 11.0 + d, 5.0 + d) for d in range(25)])
    got = features.add_if_absent(panel.withColumn("close_location", F.lit(7.0))).orderBy("date").collect()
    assert got[0].close_location == 7.0 and got[0].true_range_pct is None and got[1].true_range_pct == pytest.approx(3 / 11)
    assert got[3].dollar_volume_ratio_5d is None and got[4].dollar_volume_ratio_5d > 1
    assert got[18].volume_zscore_20d is None and got[19].volume_zscore_20d == pytest.approx(9.5 / statistics.pstdev(range(20)))


def test_diagnostics_boards_and_reports(spark):
    found = universe.add_research_universe(universe_panel(spark))
    asked = spark.createDataFrame([("GOOD", DAY + dt.timedelta(259)), ("NONE", DAY)], "ticker string, anchor_date date")
    got = {r.ticker: r for r in universe.attach_diagnostics(asked, found).collect()}
    assert got["GOOD"].research_universe_ok and not got["NONE"].research_universe_ok and got["NONE"].research_rejection_reasons == ""
    board = lambda x: spark.createDataFrame([("m", "f", x), ("n", "f", 0.0)], "model_name string, feature_set string, score double")
    assert {r.model_name: r.delta_score for r in metrics.compare_boards(board(1.0), board(3.0).filter("model_name = 'm'"), ["score"]).collect()} == {"m": 2.0}
    many = lambda xs: spark.createDataFrame([(f"m{i}", "f", x) for i, x in enumerate(xs)], "model_name string, feature_set string, score double")
    changes = metrics.board_changes(metrics.compare_boards(many([1.0, 1.0, 1.0, 1.0]), many([2.0, 4.0, 0.0, 1.0]), ["score"]), "score").first()
    assert (changes.matched_count, changes.improved_count, changes.worsened_count, changes.tie_count, changes.median_delta_score, changes.new_board_better) == (4, 2, 1, 1, 0.5, True)
    report = spark.createDataFrame([("IGNORE", 1.0, "a"), ("WATCHLIST", 9.0, "b"), ("ENTRY CANDIDATE", 5.0, "c"), ("ENTRY CANDIDATE", 2.0, "d")], "suggested_action string, ensemble_percentile double, ticker string")
    assert [r.ticker for r in signals.report_order(report).collect()] == ["d", "c", "b", "a"]
    assert signals.implied_close(spark.createDataFrame([(100.0, 0.1, 0.05)], "anchor_close double, prediction double, benchmark_return double")).first().implied_close == pytest.approx(115.0)


def test_small_selections(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "role string, status string")
    assert sorted(map(tuple, upsert.status_counts(rows).collect())) == [("a", "x", 2), ("b", "y", 1)]
    panel = bars(spark, [(t, 0, 1.0, 1.0, 1.0, 1.0, 1.0) for t in ("C", "A", "B")])
    placed = panel.withColumn("at", F.when(F.col("ticker") == "C", 0).when(F.col("ticker") == "A", 1).otherwise(2))
    assert {r.ticker for r in selection.first_tickers(placed, 2, "at").collect()} == {"A", "C"}
    dear = panel.withColumn("close", F.when(F.col("ticker") == "B", 9.0).otherwise(1.0))
    assert [r.ticker for r in selection.latest_liquid(dear, 5, 0.5, least_price=5.0).collect()] == ["B"]
    assert {r.ticker for r in upsert.without_tickers(panel, ["a"]).collect()} == {"B", "C"}
    codes = featuresets.vocabulary(rows, "role")
    assert {(r.role, r.role_code) for r in featuresets.encoded(rows.union(spark.createDataFrame([("zz", "x")], rows.schema)), "role", codes.filter("role <> 'b'")).collect()} == {("a", 1), ("b", 0), ("zz", 0)}


def test_windows_on_a_stream(spark, tmp_path):
    from ledgerline.streaming.ingest import windowed_counts

    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "a" if h % 2 else "b", float(h)) for h in range(24)], "ts timestamp, event_type string, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), width="6 hours")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("counts")) == key(windowed_counts(rows, width="6 hours")) and spark.table("counts").count() == 8
