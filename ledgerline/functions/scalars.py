"""Scalar rules of the panel: casts, ratios, codes and buckets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean a missing number, and those that mean true and false.
MISSING = ("", "NA", "N/A")
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
#: Exchange spellings and what they stand for.
EXCHANGES = {"NYSE AMERICAN": "AMEX", "NYSE MKT": "AMEX", "NYSEMKT": "AMEX"}
#: Spellings of listed exchanges in symbol lists, and exchanges over the counter.
LISTED = {"NYSE": "NYSE", "NASDAQ": "NASDAQ", "AMEX": "AMEX", "NYSE MKT": "AMEX", "NYSE AMERICAN": "AMEX", "BATS": "BATS"}
OVER_THE_COUNTER = ("OTC", "OTCBB", "OTCGREY", "OTCMKTS", "OTCQB", "OTCQX", "OTCM", "PINK")
#: Types of common equity, and markers of other securities in a type.
COMMON_TYPES = ("COMMON", "COMMON STOCK", "COMMON SHARE", "COMMON SHARES", "COMMON EQUITY", "CS", "EQUITY")
OTHER_MARKERS = ("ETF", "FUND", "TRUST", "ETN", "WARRANT", "WARRANTS", "UNIT", "UNITS", "RIGHT", "RIGHTS", "PREFERRED", "PREFERENCE")
#: Parts of a code after a hyphen (whole ones and beginnings), last letters, and words of a name, that mark
#: other securities.
OTHER_PARTS, OTHER_BEGINNINGS, OTHER_LETTERS = ("P", "R", "RT", "RW", "U", "UN", "UNIT", "W", "WS"), ("PR", "WT"), ("D", "W", "R", "U", "P")
OTHER_NAMES = r"(?i)\b(warrant|warrants|unit|units|right|rights|preferred|preference)\b"
#: Rank buckets by the percentile they end at.
RANK_BUCKETS = ((3, "TOP_3_PERCENT"), (5, "TOP_5_PERCENT"), (10, "TOP_DECILE"), (20, "TOP_20_PERCENT"), (30, "TOP_30_PERCENT"))
BELOW_BUCKETS = "BELOW_TOP_30_PERCENT"


def finite(x: Column) -> Column:
    """NaN and infinities become null; the only place where they are handled."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def lenient_double(text: Column) -> Column:
    trimmed = F.trim(text.cast("string"))
    return finite(F.when(~trimmed.isin(*MISSING), trimmed).try_cast("double"))


def lenient_bool(text: Column) -> Column:
    word = F.lower(F.trim(text.cast("string")))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if either is null or b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def log1p_guarded(x: Column) -> Column:
    return F.when(x >= 0, F.log1p(x))


def first_number(*columns: Column) -> Column:
    """The first of several fields that holds a number."""
    return F.coalesce(*[lenient_double(c) for c in columns])


def epoch_ms_date(ms: Column) -> Column:
    """The UTC date of milliseconds since 1970, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(86_400_000)).cast("int"))


def vendor_symbol(ticker: Column) -> Column:
    upper = F.upper(F.trim(ticker))
    return F.when(upper.endswith(".US"), upper).otherwise(F.concat(upper, F.lit(".US")))


def own_ticker(symbol: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(symbol)), r"\.US$", "")


def canonical_exchange(exchange: Column) -> Column:
    upper = F.upper(F.trim(F.coalesce(exchange, F.lit(""))))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair])[upper], upper)


def listed_exchange(exchange: Column, requested: Column, with_otc: bool = False) -> Column:
    """The exchange of a row in the symbol list of a requested exchange; null if the row does not belong to it.

    A blank one is the requested one. In the list of a listed exchange only its own spellings count, in another list
    any exchange does, over the counter only with_otc.
    """
    own, asked = (F.upper(F.trim(F.coalesce(x, F.lit("")))) for x in (exchange, requested))
    canonical = F.create_map(*[F.lit(x) for pair in LISTED.items() for x in pair])[own]
    found = F.when(~asked.isin(*set(LISTED.values())), F.coalesce(F.nullif(own, F.lit("")), F.nullif(asked, F.lit("")))).when(own == "", asked).when(canonical == asked, asked)
    return found if with_otc else F.when(~own.isin(*OVER_THE_COUNTER), found)


def common_equity(*types: Column) -> Column:
    """Every given type is blank, or a common one without another security's marker. Without types all pass."""
    passes = F.lit(True)
    for column in types:
        kind = F.upper(F.trim(F.coalesce(column.cast("string"), F.lit(""))))
        passes = passes & ((kind == "") | (kind.isin(*COMMON_TYPES) & ~kind.rlike("|".join(OTHER_MARKERS))))
    return passes


def other_security(code: Column, name: Column) -> Column:
    """A name or code that marks a warrant, unit, right or preferred share."""
    upper = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    beginning = lambda x: F.substring(x, 1, 2).isin(*OTHER_BEGINNINGS)
    by_part = F.exists(F.slice(F.split(upper, "-"), F.lit(2), F.length(upper) + 1), lambda x: x.isin(*OTHER_PARTS) | beginning(x))
    by_letter = ~upper.contains("-") & (F.length(upper) >= 5) & F.right(upper, F.lit(1)).isin(*OTHER_LETTERS)
    return F.coalesce(name, F.lit("")).rlike(OTHER_NAMES) | by_part | by_letter


def test_symbol(ticker: Column, name: Column, tickers: tuple[str, ...] = ("ZVZZT", "ZWZZT", "ZXZZT")) -> Column:
    upper = F.upper(F.coalesce(name, F.lit("")))
    return F.upper(ticker).isin(*tickers) | (upper.contains("TEST") & upper.rlike("STOCK|SYMBOL|ISSUE"))


def rank_bucket(percentile: Column) -> Column:
    out = F.when(percentile <= RANK_BUCKETS[0][0], RANK_BUCKETS[0][1])
    for end, label in RANK_BUCKETS[1:]:
        out = out.when(percentile <= end, label)
    return out.otherwise(BELOW_BUCKETS)


def business_days_held(entry: Column, prediction: Column) -> Column:
    """Weekdays from entry up to the day before prediction, plus one; negative counts if prediction comes first."""
    low, high = F.least(entry, prediction), F.greatest(entry, prediction)
    weekdays = F.when(high > low, F.size(F.filter(F.sequence(low, F.greatest(low, F.date_sub(high, 1))), lambda d: F.weekday(d) < 5))).otherwise(0)
    return F.when(entry.isNotNull() & prediction.isNotNull(), F.when(prediction < entry, -weekdays).otherwise(weekdays) + 1)


def weekday_calendar(first: Column, last: Column) -> Column:
    """All days from Monday to Friday in the range."""
    return F.filter(F.sequence(first, last), lambda d: F.weekday(d) < 5)


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def clipped_probabilities(scores: Column, least: float = 1e-12) -> Column:
    """Each score held within [least, 1 - least], then scaled so that a row sums to one."""
    held = F.transform(scores, lambda x: F.least(F.greatest(x, F.lit(least)), F.lit(1 - least)))
    return F.transform(held, lambda x: x / F.aggregate(held, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """The place of the largest value from 0; of equal ones the first."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
