import datetime
import math
import random

from pyspark.sql import functions as F

from ledgerline.operators import features


def test_features_of_recent_rows_need_no_older_ones(spark):
    """Nulls in every column, closes of zero (which give no return), a ticker without volumes, and a short one."""
    r = random.Random(11)
    first = datetime.date(2020, 1, 1)
    rows = []
    for t, n in (("A", 400), ("B", 400), ("N", 300), ("S", 20)):
        for i in range(n):
            close = r.choice([None, 0.0, *(r.uniform(5, 9) for _ in range(6))])
            volume = None if t == "N" or r.random() < 0.2 else float(r.randint(0, 99))
            low = r.uniform(1, 5)
            rows.append((t, first + datetime.timedelta(days=400 - n + i), low + 1, low + 5, low, close, volume, None if r.random() < 0.3 else r.uniform(1, 9)))
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, dollar_volume double")
    since = first + datetime.timedelta(days=370)
    recent = features.recent_rows(bars, F.lit(since)).persist()
    kept = {x.ticker: x.n for x in recent.groupBy("ticker").agg(F.count("*").alias("n")).collect()}
    assert kept["A"] < 200 and kept["B"] < 200 and kept["N"] == 300 and kept["S"] == 20
    whole, part = ({(x.ticker, x.date): x for x in features.daily_features(b).filter(F.col("date") >= since).collect()} for b in (bars, recent))
    assert whole.keys() == part.keys() and len(whole) == 110
    for k, x in whole.items():
        for a, b in zip(x, part[k], strict=True):
            assert a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)), (k, x, part[k])
    assert features.recent_rows(bars.limit(0), F.lit(since)).count() == 0
