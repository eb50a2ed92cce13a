"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text, and a chunk ends where the hash is the least within a window on both sides.
That place depends on the bytes around it alone, so chunks after an insertion come out as before. Chunks with equal
digests are one passage, of which the first occurrence stays; runs of repeated chunks form the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ledgerline.llm.common import bound_batches, materialize

#: Bytes that the gear hash spans, bytes on each side in which a cut is the least, and a chunk's most bytes.
GEAR, REACH, MOST = 16, 24, 4096
#: Repeated runs of fewer bytes are left alone.
PASSAGE = 100
ROWS = 50_000


def gear_table(seed: int = 2024) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


TABLE = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the table's values of the last GEAR bytes, each shifted left by its age; modulo 2**32."""
    hashes = TABLE[data]
    span = 1
    while span < GEAR:
        rolled = hashes.copy()
        rolled[span:] += hashes[:-span] << np.uint32(span)
        hashes, span = rolled, span * 2
    return hashes


def _least_before(values: np.ndarray, reach: int) -> np.ndarray:
    """At each place, the least of the `reach` values before it (the largest number where there is none)."""
    n, top = len(values), np.uint32(0xFFFFFFFF)
    least = np.full(n + reach, top, np.uint32)
    least[reach:] = values
    span = 1
    while span * 2 <= reach:
        least[span:] = np.minimum(least[span:], least[:-span])
        span *= 2
    # least[i] is now that of the last `span` values; two of them cover the reach.
    if span < reach:
        least[reach - span :] = np.minimum(least[reach - span :], least[: len(least) - (reach - span)])
    return np.concatenate((np.full(1, top, np.uint32), least[reach:-1])) if n else least[:0]


def chunk_ends(data: bytes) -> np.ndarray:
    """Where each chunk ends. Chunks are longer than REACH but for the first and last, and MOST at most."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    hashes = gear_hashes(np.frombuffer(data, np.uint8))
    before, after = _least_before(hashes, REACH), _least_before(hashes[::-1], REACH)[::-1]
    cuts = np.flatnonzero((hashes < before) & (hashes <= after)) + 1
    ends = np.append(cuts[cuts < n], n)
    starts = np.concatenate(([0], ends[:-1]))
    if (ends - starts).max() > MOST:
        ends = np.concatenate([np.append(np.arange(a + MOST, b, MOST), b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return ends


CHUNKS = "row long, doc long, start long, bytes long, high long, low long"


def _chunk_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each input row itself, where start is -1, and one for each of its chunks."""
    for batch in batches:
        docs, spans, digests, size = [], [], [], 0

        def emit():
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            where, lengths = np.concatenate(spans), [len(s) for s in spans]
            named = {"row": pa.array([r for r, _ in docs], pa.int64()), "doc": pa.array([d for _, d in docs], pa.int64())}
            each = pa.array(np.repeat(np.arange(len(docs)), lengths))
            numbers = {"start": where[:, 0], "bytes": where[:, 1], "high": pair[:, 0], "low": pair[:, 1]}
            return pa.record_batch({k: v.take(each) for k, v in named.items()} | {k: pa.array(np.ascontiguousarray(v)) for k, v in numbers.items()})

        for row, doc, text in zip(batch["row"].to_pylist(), batch["doc"].to_pylist(), batch["text"], strict=True):
            data = text.as_py() or b""
            ends = chunk_ends(data)
            starts = np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1]))
            docs.append((row, doc))
            spans.append(np.concatenate(([[-1, len(data)]], np.stack((starts, ends - starts), axis=1))))
            digests.append(bytes(16))
            digests += [xxh3_128_digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            size += len(spans[-1])
            if size >= ROWS:
                yield emit()
                docs, spans, digests, size = [], [], [], 0
        if size:
            yield emit()


def _passages(rows: DataFrame, passage: int) -> DataFrame:
    """rows: row (a key of its own), doc, text. One row each: row, doc, text_bytes and what repeated_passages tells."""
    chunked = materialize(rows.mapInArrow(_chunk_task, CHUNKS))
    chunks = chunked.filter("start >= 0")
    place = F.struct(F.col("doc").isNull().alias("nameless"), "doc", "row", "start")
    seen = chunks.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(place).alias("keeper")).filter("n > 1").select("high", "low", F.col("keeper.row").alias("keeper_row"), F.col("keeper.start").alias("keeper_start"))
    # Read anew, so that a chunk that a third of the texts hold can be split in the join.
    stays = (F.col("row") == F.col("keeper_row")) & (F.col("start") == F.col("keeper_start"))
    repeats = chunks.join(materialize(seen), ["high", "low"]).select("row", "start", "bytes", stays.alias("stays"))
    in_order = Window.partitionBy("row").orderBy("start")
    apart = F.coalesce(F.lag(F.col("start") + F.col("bytes")).over(in_order) < F.col("start"), F.lit(True))
    runs = repeats.withColumn("run", F.sum(apart.cast("int")).over(in_order))
    sums = runs.groupBy("row", "run").agg(
        F.sum("bytes").alias("bytes"),
        F.sum(F.when(~F.col("stays"), F.col("bytes")).otherwise(0)).alias("removed_bytes"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct("start", (F.col("start") + F.col("bytes")).alias("stop"))))).alias("removed"),
    )
    found = sums.filter(F.col("bytes") >= passage).groupBy("row").agg(
        F.count("*").alias("n_passages"), F.sum("bytes").alias("repeated_bytes"), F.sum("removed_bytes").alias("removed_bytes"), F.sort_array(F.flatten(F.collect_list("removed"))).alias("removed")
    )
    none = F.lit(0).cast("long")
    joined = chunked.filter("start < 0").select("row", "doc", F.col("bytes").alias("text_bytes")).join(found, "row", "left")
    return joined.select(
        "row",
        "doc",
        "text_bytes",
        F.coalesce(F.col("n_passages") > 0, F.lit(False)).alias("has_repeat"),
        *[F.coalesce(c, none).alias(c) for c in ("n_passages", "repeated_bytes", "removed_bytes")],
        (F.col("text_bytes") - F.coalesce("removed_bytes", none)).alias("kept_bytes"),
        F.coalesce("removed", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("removed"),
    )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """One row per input row: id, text_bytes, has_repeat, n_passages, repeated_bytes, removed_bytes, kept_bytes, removed.

    A passage is a run of chunks that each occur elsewhere too, in this text or another, and of at least `passage` bytes
    in all. Of a chunk's occurrences the first in the smallest id stays; the others, within passages, are what `removed`
    lists as byte spans (start, stop) of the UTF-8 text. Null text counts as empty and has none. Rows that share an id,
    or have none, are texts of their own, in the order of the table; those without an id come last. An empty table
    gives no rows.
    """
    rows = bound_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return _passages(rows, passage).drop("row").withColumnRenamed("doc", id_col)


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """The documents without their repeated passages, as many rows as there were. A character that a span cuts through stays."""
    rows = materialize(bound_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("all")))
    found = _passages(rows.select("row", F.col(f"all.`{id_col}`").cast("long").alias("doc"), F.col(f"all.`{text_col}`").cast("binary").alias("text")), passage)
    joined = rows.join(found.select("row", "removed"), "row", "left")
    names = docs.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            columns, texts = list(batch.columns[:-1]), []
            for text, spans in zip(columns[at].to_pylist(), batch.columns[-1].to_pylist(), strict=True):
                if text is not None and spans:
                    data, kept, end = text.encode(), [], 0
                    for span in spans:
                        start, stop = span["start"], span["stop"]
                        while start < stop and data[start] & 0xC0 == 0x80:
                            start += 1
                        while start < stop < len(data) and data[stop] & 0xC0 == 0x80:
                            stop -= 1
                        kept.append(data[end:start])
                        end = max(end, stop)
                    text = b"".join([*kept, data[end:]]).decode()
                texts.append(text)
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=names)

    return joined.select(*[F.col(f"all.`{c}`") for c in names], F.col("removed").alias("_spans")).mapInArrow(task, docs.schema)
