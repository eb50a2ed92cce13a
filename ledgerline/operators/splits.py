"""Splits by date: holdout, walk-forward folds with purge gaps, and the final fit."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FoldRules:
    """Dates in the first training set, validation, test, and the gap before each of the latter two."""

    min_train: int = 252
    val: int = 21
    oos: int = 21
    purge: int = 20

    def checked(self, longest_horizon: int) -> FoldRules:
        """The rules with a purge gap that no label of the longest horizon crosses."""
        return FoldRules(self.min_train, self.val, self.oos, max(self.purge, longest_horizon))


def distinct_dates(panel: DataFrame, date: str = "date") -> list:
    """All dates in order. A panel has a few thousand, whatever its rows."""
    return [r[0] for r in panel.select(date).distinct().orderBy(date).toLocalIterator()]


@dataclass(frozen=True)
class Span:
    """The dates of one split of a fold: all from the first to the last."""

    fold: int
    split: str
    first: date
    last: date


def _spans(fold: int, **parts: list) -> list[Span]:
    return [Span(fold, name, ds[0], ds[-1]) for name, ds in parts.items() if ds]


def walk_forward(dates: list, rules: FoldRules = FoldRules(), purge_validation: bool = False) -> list[Span]:
    """Expanding folds over dates in order. purge_validation keeps the gap between training and validation too."""
    found, start, fold = [], rules.min_train + rules.val + rules.purge, 0
    while start + rules.oos <= len(dates):
        end = start - rules.purge
        cut = max(0, end - rules.val - (rules.purge if purge_validation else 0))
        found += _spans(fold, train=dates[0:1] + dates[cut - 1 : cut] if cut else [], val=dates[end - rules.val : end], oos=dates[start : start + rules.oos])
        start, fold = start + rules.oos, fold + 1
    return found


def last_fold(dates: list, rules: FoldRules = FoldRules()) -> list[Span]:
    """One fold whose test set is the last dates."""
    start = len(dates) - rules.oos
    if start < rules.min_train + rules.val + rules.purge:
        raise ValueError("too few dates for a fold")
    early = dates[: start - rules.purge]
    return _spans(0, train=early[: -rules.val], val=early[-rules.val :], oos=dates[start:])


def final_fit(dates: list, rules: FoldRules = FoldRules()) -> list[Span]:
    """For deployment: the last block stops the fit early, then all dates are fitted again."""
    if len(dates) <= rules.val:
        raise ValueError("too few dates for a final fit")
    return _spans(0, train=dates[: -rules.val], val=dates[-rules.val :], refit=dates)


def holdout(dates: list) -> list[Span]:
    """70, 15 and 15 percent of the dates in order."""
    n = len(dates)
    if n < 3:
        raise ValueError("a holdout needs three dates")
    a = max(1, int(0.7 * n))
    b = min(max(a + 1, int(0.85 * n)), n - 1)
    return _spans(0, train=dates[:a], val=dates[a:b], test=dates[b:])


def split_rows(panel: DataFrame, spans: list[Span], date: str = "date") -> DataFrame:
    """The panel's rows once for each fold and split of their date: a join by range with three bounds a fold."""
    table = panel.sparkSession.createDataFrame([(s.fold, s.split, s.first, s.last) for s in spans], "fold_id int, split string, _first date, _last date")
    return panel.join(F.broadcast(table), F.col(date).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def split_sizes(panel: DataFrame, spans: list[Span], date: str = "date") -> DataFrame:
    """fold_id, split, first_date, last_date, dates, rows. Rows are counted by date first, so a date meets the folds once."""
    counted = panel.groupBy(date).agg(F.count("*").alias("_rows"))
    return split_rows(counted, spans, date).groupBy("fold_id", "split").agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("dates"), F.sum("_rows").alias("rows"))
