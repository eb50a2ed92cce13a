"""DuckDB SQL for the derived panels, as common table expressions."""

from ledgerline.operators.features import DAILY, DAILY_FLAGS

TICKERS = """
tickers AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS ticker, r_name AS gics_sector,
         CASE WHEN s_suppkey % 7 = 0 THEN 'OTC' WHEN s_suppkey % 3 = 0 THEN 'NYSE MKT' WHEN s_suppkey % 3 = 1 THEN 'nyse' ELSE 'NASDAQ' END AS exchange,
         CASE WHEN s_suppkey % 9 = 0 THEN 'ETF' WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Common Stock' END AS type, s_name AS name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

BARS = """
li AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p, l_quantity AS q,
         row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity) AS rn,
         row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_partkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS rd
  FROM lineitem),
bars0 AS (
  SELECT ticker, date, max(CASE WHEN rn = 1 THEN p END) AS open, max(p) AS high, min(p) AS low, max(CASE WHEN rd = 1 THEN p END) AS close, sum(q) AS volume
  FROM li GROUP BY ticker, date),
bars AS (SELECT *, close * volume AS dollar_volume FROM bars0)"""

HOLED = (
    BARS.replace("bars AS (SELECT *", "bars1 AS (SELECT *")
    + """,
bars AS (SELECT ticker, date, open, high, low, volume,
                CASE WHEN (CAST(substr(ticker, 2, 6) AS INT) * 31 + day(date)) % 7 <> 0 THEN close END AS close,
                CASE WHEN (CAST(substr(ticker, 2, 6) AS INT) * 31 + day(date)) % 7 <> 0 THEN dollar_volume END AS dollar_volume
         FROM bars1)"""
)

CONTEXT = """
ctx0 AS (
  SELECT 'MKT' AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS v, l_quantity AS q FROM lineitem
  UNION ALL
  SELECT t.gics_sector, CAST(l_shipdate AS DATE), l_extendedprice, l_quantity FROM lineitem JOIN tickers t ON CAST(substr(t.ticker, 2, 6) AS BIGINT) = l_suppkey),
ctx1 AS (
  SELECT ticker, date, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(q AS DECIMAL(18,2))) AS DOUBLE) AS close, CAST(sum(CAST(q AS DECIMAL(18,2))) AS DOUBLE) AS volume
  FROM ctx0 GROUP BY ticker, date),
context AS (SELECT ticker, date, close AS open, close AS high, close AS low, close, volume, close * volume AS dollar_volume FROM ctx1)"""


def features(source: str, out: str) -> str:
    """Daily features of a bars relation: dense windows over the rows that hold a value."""

    def dense(name: str, value: str, sizes: str) -> str:
        return f"""
{out}_{name} AS (SELECT ticker, date, {sizes} FROM (SELECT ticker, date, {value} AS v, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM {out}_b WHERE {value} IS NOT NULL)
  WINDOW w4 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), w60 AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING))"""

    back = ", ".join(f"lag(v, {n - 1}) OVER (PARTITION BY ticker ORDER BY date) AS back{n}" for n in (5, 20, 60))
    avg = "CASE WHEN k >= 20 THEN avg(v) OVER w20 END AS a20, CASE WHEN k >= 60 THEN avg(v) OVER w60 END AS a60"
    return f"""
{out}_a AS (SELECT *, lag(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS prev_close,
                   count(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}),
{out}_b AS (SELECT *, close / nullif(prev_close, 0) - 1 AS return_1d FROM {out}_a),
{dense("c", "close", f"k, v, {back}, {avg}, CASE WHEN k >= 19 THEN avg(v) OVER (PARTITION BY ticker ORDER BY date ROWS 18 PRECEDING) END AS p19, CASE WHEN k >= 59 THEN avg(v) OVER (PARTITION BY ticker ORDER BY date ROWS 58 PRECEDING) END AS p59")},
{dense("r", "return_1d", "CASE WHEN k >= 20 THEN stddev_pop(v) OVER w20 END AS s20, CASE WHEN k >= 60 THEN stddev_pop(v) OVER w60 END AS s60")},
{dense("v", "volume", avg + ", CASE WHEN k >= 20 THEN stddev_pop(v) OVER w20 END AS s20")},
{dense("d", "dollar_volume", avg + ", CASE WHEN k >= 5 THEN avg(v) OVER w4 END AS a5")},
{out}_e AS (
  SELECT b.*, CASE WHEN 1 + return_1d > 0 THEN ln(1 + return_1d) END AS log_return_1d, open / nullif(prev_close, 0) - 1 AS gap_pct, close / nullif(open, 0) - 1 AS intraday_return,
    (high - low) / nullif(close, 0) AS hl_range_pct, CASE WHEN close <> 0 THEN (close - low) / nullif(high - low, 0) END AS close_location,
    CASE WHEN prev_close IS NOT NULL THEN greatest(high - low, abs(high - prev_close), abs(low - prev_close)) / nullif(prev_close, 0) END AS true_range_pct,
    b.close / nullif(c.back5, 0) - 1 AS rolling_return_5d, b.close / nullif(c.back20, 0) - 1 AS rolling_return_20d, b.close / nullif(c.back60, 0) - 1 AS rolling_return_60d,
    r.s20 AS rolling_vol_20d, r.s60 AS rolling_vol_60d, v.a20 AS rolling_avg_volume_20d, v.a60 AS rolling_avg_volume_60d, v.s20 AS volume_sd,
    d.a20 AS rolling_avg_dollar_volume_20d, d.a60 AS rolling_avg_dollar_volume_60d, d.a5 AS dollars_5,
    coalesce(c.a20, l.p19) AS sma_close_20d, coalesce(c.a60, l.p59) AS sma_close_60d
  FROM {out}_b b LEFT JOIN {out}_c c USING (ticker, date) LEFT JOIN {out}_r r USING (ticker, date) LEFT JOIN {out}_v v USING (ticker, date) LEFT JOIN {out}_d d USING (ticker, date)
    ASOF LEFT JOIN {out}_c l ON b.ticker = l.ticker AND b.date >= l.date AND b.close IS NULL),
{out} AS (
  SELECT *, close / nullif(sma_close_20d, 0) - 1 AS price_vs_sma_20d, close / nullif(sma_close_60d, 0) - 1 AS price_vs_sma_60d, rolling_return_20d AS momentum_20d, rolling_return_60d AS momentum_60d,
    CASE WHEN volume <> 0 THEN volume / nullif(rolling_avg_volume_20d, 0) END AS volume_ratio_20d, CASE WHEN dollar_volume <> 0 THEN dollar_volume / nullif(dollars_5, 0) END AS dollar_volume_ratio_5d,
    (volume - rolling_avg_volume_20d) / nullif(volume_sd, 0) AS volume_zscore_20d, prev_close IS NOT NULL AS has_prev_close, before >= 19 AS has_20d_history, before >= 59 AS has_60d_history
  FROM {out}_e)"""


#: What the models take, of bars whose closes and volumes are all there: x1 to x5, and y, the excess return over five rows.
MODEL_ROWS = f"""{BARS},
mk AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS m FROM lineitem GROUP BY 1),
nb AS (SELECT bars.*, m, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM bars LEFT JOIN mk USING (date)),
mo AS (SELECT ticker, date, close / nullif(lag(close, 4) OVER w, 0) - 1 AS x1, close / nullif(lag(close, 19) OVER w, 0) - 1 AS x2, CASE WHEN count(r) OVER v = 20 THEN stddev_pop(r) OVER v END AS x3,
  CASE WHEN volume <> 0 AND count(*) OVER v = 20 THEN volume / nullif(avg(volume) OVER v, 0) END AS x4, CASE WHEN close <> 0 THEN (close - low) / nullif(high - low, 0) END AS x5,
  lead(close, 5) OVER w / nullif(close, 0) - 1 - (lead(m, 5) OVER w / nullif(m, 0) - 1) AS y
  FROM nb WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING))"""


def moments(columns: list[str]) -> str:
    """Count, means, deviations and covariances of columns, nulls as 0, and of the target, as aggregates."""
    x = {c: f"coalesce({c}, 0)" for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = ", ".join(f"avg({v}) AS m_{c}, stddev_pop({v}) AS s_{c}, covar_pop({v}, y) AS c_{c}" for c, v in x.items())
    return f"count(*)::DOUBLE AS n, avg(y) AS my, stddev_pop(y) AS sy, {one}, {', '.join(f'covar_pop({x[a]}, {x[b]}) AS c_{a}_{b}' for a, b in pairs)}"


def ridge(source: str, out: str, columns: list[str], penalty: float = 10.0, keys: str = "") -> str:
    """The weights w_<column> of scaled columns with a squared penalty, from a relation of moments: elimination, a step a column."""
    n, kept = range(len(columns)), "".join(f"{k}, " for k in keys.split())
    pair = lambda i, j: "_".join(columns[k] for k in sorted((i, j)))
    first = ", ".join([*(f"n * c_{pair(i, j)} / (s_{columns[i]} * s_{columns[j]}){f' + {penalty}' if i == j else ''} AS a{i}{j}" for i in n for j in n), *(f"n * c_{columns[i]} / s_{columns[i]} AS b{i}" for i in n)])
    steps = [f"{out}0 AS (SELECT {kept}{first} FROM {source})"]
    for p in n:
        row = lambda i, c, p=p: f"{c.format(p)} / a{p}{p} AS {c.format(p)}" if i == p else f"{c.format(i)} - a{i}{p} * {c.format(p)} / a{p}{p} AS {c.format(i)}"
        steps.append(f"{out}{p + 1} AS (SELECT {kept}{', '.join(row(i, c) for i in n for c in [*(f'a{{}}{j}' for j in n), 'b{}'])} FROM {out}{p})")
    return ", ".join([*steps, f"{out} AS (SELECT {kept}{', '.join(f'b{i} AS w_{c}' for i, c in enumerate(columns))} FROM {out}{len(columns)})"])


def ridge_value(columns: list[str]) -> str:
    return "my + " + " + ".join(f"w_{c} * (coalesce({c}, 0) - m_{c}) / s_{c}" for c in columns)


FEATURE_COLUMNS, FLAG_COLUMNS = DAILY, DAILY_FLAGS


def cross_section(source: str, out: str, features: list[str], keys: list[str], suffix: str, least: int, coverage: str) -> str:
    """z, percentile and coverage of each feature among the rows of a group that hold it."""
    by = ", ".join(keys)
    cols = []
    for c in features:
        n = f"count({c}) OVER (PARTITION BY {by})"
        rank = f"(rank() OVER (PARTITION BY {by}, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0)"
        cols.append(f"CASE WHEN {c} IS NOT NULL AND {n} >= {least} THEN ({c} - avg({c}) OVER (PARTITION BY {by})) / nullif(stddev_pop({c}) OVER (PARTITION BY {by}), 0) END AS {c}__{suffix}_z")
        cols.append(f"CASE WHEN {c} IS NOT NULL AND {n} >= {least} THEN ({rank} - 1) / nullif({n} - 1, 0) END AS {c}__{suffix}_pct")
    counts = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN count({c}) OVER (PARTITION BY {by}) END" for c in features)
    return f"{out} AS (SELECT *, {', '.join(cols)}, least({counts}) AS {coverage} FROM {source})"


def logged(source: str, out: str, columns: list[str]) -> str:
    return f"{out} AS (SELECT *, {', '.join(f'CASE WHEN {c} >= 0 THEN ln(1 + {c}) END AS log1p_{c}' for c in columns)} FROM {source})"


#: Added before rounding down: exact decimals of the data, which would lie on a rounding edge, stay clear of it.
OFFSET = 0.6180339887
#: Columns of large numbers, rounded to fewer digits.
LARGE = ("open", "high", "low", "close", "prev_close", "volume", "dollar_volume", "rolling_avg", "sma_close", "fundamental_", "median_dollar", "current_dollar")


def digits_of(column: str) -> int:
    return 2 if column.removeprefix("research_").removeprefix("eligibility_avg_").startswith(LARGE) and not column.endswith(("_vs_median20", "_location", "_missing", "_to_sma200")) and "ratio" not in column and "zscore" not in column else 6


def rounded(columns: list[str]) -> str:
    return ", ".join(f"floor({c} * 1e{digits_of(c)} + {OFFSET}) / 1e{digits_of(c)} AS {c}" for c in columns)
