import datetime as dt

from ledgerline.streaming.ingest import stream_bars

DAY = dt.date(2024, 1, 1)
SCHEMA = "ticker string, date date, close double"


def test_stream_merges_history_lagging_tickers_and_late_rows(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")

    def load(rows):
        frame = spark.createDataFrame([(t, None if d is None else DAY + dt.timedelta(d), c) for t, d, c in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(source)
        stream_bars(spark, source, frame.schema, table, str(tmp_path / "c")).awaitTermination()
        return {(r.ticker, (r.date - DAY).days): r.close for r in spark.read.parquet(table).collect()}

    history = {("A", d): 1.0 for d in range(400)} | {("LAG", d): 2.0 for d in range(100)}
    assert load([(*k, c) for k, c in history.items()]) == history
    # A recent correction, an old one, one that repeats what is stored, a row that was missing, a new ticker and one that
    # lags, and a row without a date.
    got = load([("A", 399, 5.0), ("A", 3, 6.0), ("A", 4, 1.0), ("A", -30, 7.0), ("NEW", 5, 8.0), ("LAG", 99, 9.0), ("LAG", 100, 9.0), ("A", None, 4.0)])
    assert got == history | {("A", 399): 5.0, ("A", 3): 6.0, ("A", -30): 7.0, ("NEW", 5): 8.0, ("LAG", 99): 9.0, ("LAG", 100): 9.0}
    assert [(r.ticker, r.close) for r in spark.read.parquet(table + "_unkeyed").collect()] == [("A", 4.0)]
    # In one file the later row counts, and tickers are in capitals.
    assert load([("A", 399, 9.0), ("a", 399, 1.0), ("A", 398, 1.0), ("A", 398, 9.0)]) == got | {("A", 399): 1.0, ("A", 398): 9.0}
