import datetime as dt
import json

from ledgerline.sources import bars as sources
from ledgerline.sources import sinks


def test_bar_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("date,ticker,open,high,low,close,volume,adjusted,dollar_volume\n2024-01-02,aa,1,2,N/A,1.5,,yes,NaN\n")
    (row,) = sources.read_bars(spark, str(tmp_path / "b.csv")).collect()
    assert (row.ticker, row.date, row.low, row.volume, row.adjusted, row.dollar_volume) == ("AA", dt.date(2024, 1, 2), None, None, True, None)


def test_adjustment(spark):
    rows = spark.createDataFrame([("A", 10.0, 12.0, 8.0, 10.0, 5.0, 100.0), ("B", 1.0, 1.0, 1.0, 0.0, 2.0, 3.0), ("C", 1.0, 1.0, 1.0, None, None, 3.0)], "ticker string, open double, high double, low double, close double, adjusted_close double, volume double")
    got = {r.ticker: r for r in sources.adjust(rows).collect()}
    assert set(got) == {"A", "B"} and (got["A"].open, got["A"].high, got["A"].close, got["A"].volume, got["A"].raw_close) == (5.0, 6.0, 5.0, 100.0, 10.0)
    assert got["B"].adjustment_factor == 1.0


def test_listing(spark):
    rows = [
        (1, "AAA", "Acme Inc", "NYSE MKT", "USD", "Common Stock", "i"), (2, "AAA", "Later", "NYSE", "USD", "Common Stock", "i"), (3, "BBB-WS", "B", "NYSE", "USD", "Common Stock", "i"),
        (4, "CCC", "C Preferred", "NYSE", "USD", "Common Stock", "i"), (5, "DDD", "D", "PINK", "USD", "Common Stock", "i"), (6, "EEE", "E", "NYSE", "EUR", "Common Stock", "i"), (7, "FFF", "F", "NYSE", "USD", "ETF", "i"),
    ]
    df = spark.createDataFrame(rows, "at int, Code string, Name string, Exchange string, Currency string, Type string, Isin string")
    (row,) = sources.listing(df, "AMEX", "at").collect()
    assert (row.symbol, row.exchange, row.name) == ("AAA.US", "AMEX", "Acme Inc")
    blank = spark.createDataFrame([(1, "AAA", "A", None, "USD", "Common Stock"), (2, "BBB", "B", "NYSE", "", "Common Stock"), (3, "CCC", "C", "NYSE", "USD", None), (4, "ddd", "", "", "", "")], "at int, Code string, Name string, Exchange string, Currency string, Type string")
    got = {r.ticker: r for r in sources.listing(blank, "NYSE", "at", is_delisted=True).collect()}
    assert set(got) == {"AAA", "BBB", "CCC", "DDD"} and got["DDD"].exchange == "NYSE" and got["DDD"].name is None and got["BBB"].currency is None and got["AAA"].is_delisted


def test_sentiment_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("ticker,vendor_symbol,date,sentiment_count_raw,sentiment_normalized_raw\naa,AA.US,2024-01-02T00:00,3.0,0.5\nbb,,2024-01-02,x,NaN\n,,2024-01-02,1,1\ncc,,,1,1\n")
    got = sorted(map(tuple, sources.read_sentiment(spark, str(tmp_path / "s.csv")).collect()))
    assert got == [("AA", dt.date(2024, 1, 2), 3.0, 0.5), ("BB", dt.date(2024, 1, 2), 0.0, None)]
    assert sources.read_sentiment(spark, str(tmp_path / "absent.csv")).count() == 0


def test_aggregates_and_payload_files(spark, tmp_path):
    payload = json.dumps({"ticker": "aa", "adjusted": True, "results": [{"t": 1704153600000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10, "vw": 1, "n": 3}]})
    (tmp_path / "AA__US.json").write_text(payload)
    (tmp_path / "note.txt").write_text("x")
    read = sources.read_payloads(spark, str(tmp_path))
    assert [r.symbol for r in read.collect()] == ["AA.US"]
    (row,) = sources.aggregate_bars(read).collect()
    assert (row.ticker, row.date, row.dollar_volume) == ("AA", dt.date(2024, 1, 2), 15.0)


def test_metadata_and_fill(spark):
    raw = spark.createDataFrame([(1, "aa.us", "", "Tech"), (2, "AA.US", "Energy", ""), (3, None, "x", "y")], "at int, symbol string, gics_sector string, sector string")
    meta = sources.metadata(raw, "at")
    assert [tuple(r) for r in meta.collect()] == [("AA", "Energy", "Unknown")]
    panel = spark.createDataFrame([("AA", ""), ("AA", "Own"), ("ZZ", None)], "ticker string, gics_sector string")
    assert sorted(r.gics_sector for r in sources.fill_metadata(panel, meta).collect()) == ["Energy", "Own", "Unknown"]


def test_bulk_wiki_and_contiguity(spark):
    bulk = spark.createDataFrame([("", "bb", "NYSE AMERICAN"), (None, "", "x")], "code string, symbol2 string, exch string")
    (row,) = sources.bulk_rows(bulk, ("code", "symbol2"), ("exch",)).collect()
    assert (row.symbol, row.ticker, row.exchange) == ("BB.US", "BB", "AMEX")
    page = "{|\n! Symbol\n|-\n| [[AA Inc|AA]] || [[Acme]]<ref>x</ref> || Energy\n|-\n|bb||'''Bee'''||Tech\n|}"
    got = sources.wiki_constituents(spark.createDataFrame([(page,)], "page string")).orderBy("place").collect()
    assert [(r.symbol, r.name, r.sector) for r in got] == [("AA", "Acme", "Energy"), ("BB", "Bee", "Tech")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate("AABBA")], "i int, ticker string")
    assert [r.ticker for r in sources.reappearing_tickers(rows, "i").collect()] == ["A"]


def test_sinks(spark, tmp_path):
    panel = spark.createDataFrame([("A", dt.date(2024, 1, 2)), ("B", dt.date(2024, 2, 2))], "ticker string, date date")
    path = str(tmp_path / "panel")
    sinks.write_panel(panel, path)
    assert spark.read.parquet(path).filter("month = '2024-02'").count() == 1
    assert sinks.write_manifest(panel, str(tmp_path / "m"), {"note": "x"})["ticker_count"] == 2
    assert sinks.fresher(spark, path, str(tmp_path / "absent")) == path and sinks.fresher(spark, str(tmp_path / "absent"), path) == path


def test_processed_flat_and_context(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ticker,date,close,has_prev_close,extra\nA,2024-01-02,NA,true,z\nB,2024-01-02,2.5,,z\n")
    got = sources.read_processed(spark, str(tmp_path / "p.csv"), ["close", "absent"], ["has_prev_close"]).orderBy("ticker").collect()
    assert [(r.ticker, r.close, r.has_prev_close) for r in got] == [("A", None, True), ("B", 2.5, None)] and "extra" not in got[0]
    wanted = spark.createDataFrame([("B",)], "ticker string")
    flat = sources.read_flat_files(spark, str(tmp_path / "p.csv"), wanted, "ticker string, date string, close string, has_prev_close string, extra string")
    assert [r.ticker for r in flat.collect()] == ["B"]
    panel = spark.createDataFrame([("SPY", 1.0), ("A", float("nan"))], "ticker string, x double")
    assert [r.ticker for r in sources.context_rows(spark, None, panel, ["SPY"]).collect()] == ["SPY"]
    assert [r.ticker for r in sources.context_rows(spark, str(tmp_path / "absent"), panel, ["SPY"]).collect()] == ["SPY"]
    assert {r.x for r in sources.clean(panel).collect()} == {1.0, None}


def test_stages_are_taken_up_again(spark, tmp_path):
    from ledgerline.sources.stages import run_stages

    ran = []

    def stage(name, add):
        def f(_, rows):
            ran.append(name)
            return rows.selectExpr(f"x + {add} AS x")

        return name, f

    rows, folder = spark.createDataFrame([(1,), (2,)], "x int"), str(tmp_path / "run")
    go = lambda stages, made_of, **k: (ran.clear(), sorted(r.x for r in run_stages(spark, rows, stages, folder, made_of, **k).collect()), list(ran))[1:]
    a, b = stage("a", 1), stage("b", 10)
    assert go([a, b], {"v": 1}) == ([12, 13], ["a", "b"]) and go([a, b], {"v": 1}) == ([12, 13], [])
    assert go([a, b, stage("c", 100)], {"v": 1}) == ([112, 113], ["c"])  # only what is new
    assert go([a, b], {"v": 2}) == ([12, 13], ["a", "b"]) and go([a, b], {"v": 2}, resume=False) == ([12, 13], ["a", "b"])


def test_sector_funds(spark):
    from ledgerline.operators.enrich import add_sector_funds

    panel = spark.createDataFrame([("Energy",), (" Utilities ",), ("Unknown",), (None,)], "gics_sector string")
    assert [r.sector_etf for r in add_sector_funds(panel).collect()] == ["XLE", "XLU", None, None]
