"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams (one to three letters, words padded with a blank) by rank. A
document is compared with each profile by the out-of-place distance: the sum, over the document's own most frequent
n-grams, of how far each stands from its rank in the profile, or the longest distance where it is absent.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_batches, release

#: n-grams in a profile, and those of a document that are compared.
PROFILE = 300
#: Distinct (language, n-gram) entries that a task gathers before it sums them up.
GATHER = 2_000_000
BLANK, BITS = 32, 21


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers, ascending, and how often each occurs; none if the text has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other characters, the first after a letter stays, as a blank
    line = np.where(letter, points, BLANK)[keep].astype(np.uint64)
    line = np.concatenate(([BLANK], line, [BLANK] if letter[-1] else [])).astype(np.uint64)
    two = (line[:-1] << BITS) | line[1:]
    three = ((two[:-1] << BITS) | line[2:])[line[1:-1] != BLANK]
    return np.unique(np.concatenate((line[line != BLANK], two, three)), return_counts=True)


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams by rank; of equal counts the smaller number first."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.add.reduceat(counts, first)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def emit():
        for lang, parts in held.items():
            grams, counts = _summed(parts)
            for i in range(0, len(grams), 50_000):
                part = slice(i, i + 50_000)
                yield pa.record_batch({"lang": pa.array([lang] * len(grams[part]), pa.string()), "gram": grams[part].astype(np.int64), "n": counts[part].astype(np.int64)})

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            grams, counts = gram_counts(text.as_py())
            if len(grams):
                held.setdefault(lang, []).append((grams, counts))
                size += len(grams)
            if size > GATHER:
                held = {k: [_summed(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > GATHER // 2:
                    yield from emit()
                    held, size = {}, 0
    yield from emit()
    held.clear()
    release()


def train_profiles(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language, from all rows whose language and text are not null: n-grams by rank.

    Counts are summed within tasks, then by language and n-gram. Only the top of each language comes to the driver.
    """
    known = bound_batches(rows).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.mapInArrow(_count_task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").select("lang", "gram").toLocalIterator():
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


class RankProfiles:
    """Profiles laid out for comparison: the rank of every known n-gram in each language, ties to the first label."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.labels = size, sorted(profiles)
        self.grams = np.unique(np.concatenate([np.asarray(profiles[x], np.uint64) for x in self.labels])) if profiles else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.labels), len(self.grams)), -1, np.int32)
        for i, label in enumerate(self.labels):
            self.ranks[i, np.searchsorted(self.grams, np.asarray(profiles[label], np.uint64))] = np.arange(len(profiles[label]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = gram_counts(text or "")
        if not len(grams) or not self.labels:
            return "und", 0.0
        top = top_grams(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == top, self.ranks[:, at], -1)
        off = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top), dtype=np.int32))).sum(axis=1)
        best = int(np.argmin(off))
        return self.labels[best], float(1 - off[best] / (self.size * len(top)))


def identify(rows: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to the rows' other columns.

    Null or letterless text, or no profile at all, gives `und` and 0. The columns lang_pred and score are replaced if
    the rows have them. Whole texts count; a text of any length is one row's work.
    """
    model = RankProfiles(profiles, size)
    kept = bound_batches(rows).select(*[c for c in rows.columns if c not in ("lang_pred", "score")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch[text_col]]
            yield pa.record_batch([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
        release()

    return kept.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double")


def fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % parts
