"""Language-model scoring by prediction by partial matching over bytes, beside a unigram base.

A text is a sequence of words and one end. PPM codes it byte by byte, a blank between words and an end after the last,
in the context of the four bytes before, across words: the longest context known from training predicts the byte, or
escapes, with as much weight as it has distinct bytes, to the next shorter one, in which the bytes already ruled out
no longer count. An end stands before the first byte too.

What a byte costs depends on its string alone, the byte and the four before it. So documents are dealt to blocks; a
block's distinct words and distinct strings go, packed by bucket, to where their training counts are summed over all
blocks, and come back with what they cost. The trie is dealt by the last three bytes of a context: a bucket has all of
orders three and four below its own triples, and a triple has 65,536 strings at most, however common it is. The order
two of a pair of bytes, 256 strings at most, is summed over the buckets that have triples of the pair and sent to them.
Of orders one and zero, which all share, there are no more than 65,792 strings; these are broadcast.

No task takes what all blocks have of one bucket: sums are taken over FAN blocks, then over FAN of such sums, and on until
one is left, and SPREAD blocks ask beside one copy of a bucket's counts. Nothing is left out, however seldom it occurs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_batches, materialize, release

ORDER = 4
#: Bytes of text in a block, and of all text for a bucket.
BLOCK, BUCKET = 24 << 20, 256 << 20
#: Bytes that are looked at together, and strings that are gathered before they are summed up.
STEP, GATHER = 1 << 20, 4_000_000
#: Blocks, or sums over them, that are summed up in one go, and blocks that ask beside one copy of a bucket's counts.
FAN, SPREAD = 64, 4096
BLANK, END = b" ", b"\n"
LEAD = b"\0" * (ORDER - 1) + END
MASKS = [np.uint64((1 << 8 * n) - 1) for n in range(ORDER + 2)]


def split_words(text: bytes | None) -> list[bytes]:
    """Lower-cased A-Z; split at space and U+0009 to U+000D. Methods of bytes know ASCII only."""
    return (text or b"").lower().split()


def strings_of(lines: list[bytes]) -> Iterator[np.ndarray]:
    """For each byte of each line and its end, in turn, the string of it and the four before it; some at a time."""
    if not lines:
        return
    data = np.frombuffer(LEAD + (END + LEAD).join(lines) + END, np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    coded = np.ones(len(data), bool)
    begins = np.cumsum(sizes + ORDER) - sizes
    coded[(begins[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    for at in range(ORDER, len(data), STEP):
        part = data[at - ORDER : at + STEP].astype(np.uint64)
        strings = part[ORDER:].copy()
        for back in range(1, ORDER + 1):
            strings |= part[ORDER - back : len(part) - back] << np.uint64(8 * back)
        yield strings[coded[at : at + STEP]]


def grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


class Tally:
    """Sums of counts by string; what is gathered is summed up again and again."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        self.held = 0

    def add(self, strings: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((strings, counts))
        self.held += len(strings)
        if self.held > max(GATHER, 2 * len(self.parts[0][0])):
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            self.parts, self.held = [grouped(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))], 0
        return self.parts[0]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in an ascending table, and whether they do."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class PpmModel:
    """A pretrained context trie, or the part of it below some triples of bytes.

    For each length of context: the strings of a context and a byte with their counts, and the contexts with all that
    followed them. Of the n times a context was seen, each of its bytes gives half a count to the escape.
    """

    def __init__(self, strings: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None, middle: tuple[np.ndarray, np.ndarray] | None = None):
        """strings: those of five bytes, with their training counts; low, middle: those of two and three bytes, if they come from more than these."""
        seen = counts > 0
        strings, counts = strings[seen], counts[seen]
        low = grouped(strings & MASKS[2], counts) if low is None else low
        middle = (strings, counts) if middle is None else middle
        self.strings, self.counts, self.contexts, self.totals, self.kinds, self.ruled_out = [], [], [], [], [], []
        for n in range(ORDER + 1):
            longer, n_longer = low if n < 2 else middle if n == 2 else (strings, counts)
            own, sums = grouped(longer & MASKS[n + 1], n_longer)
            contexts, totals = grouped(own >> np.uint64(8), sums)
            above = np.searchsorted(contexts, own >> np.uint64(8))
            self.kinds.append(np.bincount(above, minlength=len(contexts)))
            # What the bytes seen in a context weigh in the next shorter one.
            if n:
                at, found = _find(self.strings[n - 1], own & MASKS[n])
                weights = np.where(found, self.counts[n - 1][at], 0) if len(self.strings[n - 1]) else np.zeros(len(own))
                self.ruled_out.append(np.bincount(above, weights, len(contexts)))
            else:
                self.ruled_out.append(None)
            for held, x in zip((self.strings, self.counts, self.contexts, self.totals), (own, sums, contexts, totals), strict=True):
                held.append(x)

    def log10(self, strings: np.ndarray) -> np.ndarray:
        """The log10 probability of the last byte of each string after the others."""
        out, open_, came = np.zeros(len(strings)), np.ones(len(strings), bool), np.full(len(strings), -1)
        left = np.full(len(strings), 256)
        for n in range(ORDER, -1, -1):
            at, known = _find(self.contexts[n], (strings >> np.uint64(8)) & MASKS[n])
            use = np.flatnonzero(open_ & known)
            if not len(use):
                continue
            at, above = at[use], came[use]
            total, kinds = self.totals[n][at].astype(float), self.kinds[n][at]
            left[use] = 256 - kinds
            if n < ORDER:
                total = total - np.where(above >= 0, self.ruled_out[n + 1][above], 0)
                kinds = kinds - np.where(above >= 0, self.kinds[n + 1][above], 0)
            place, seen = _find(self.strings[n], strings[use] & MASKS[n + 1])
            weight = np.where(seen, self.counts[n][place] - 0.5, kinds / 2)
            out[use] += np.log10(weight / np.where(weight > 0, total, 1), where=weight > 0, out=np.zeros(len(use)))
            came[use] = at
            open_[use[seen]] = False
        return out - np.where(open_, np.log10(np.maximum(left, 1)), 0.0)


def _pack(words: list[bytes]) -> bytes:
    return BLANK.join(words)


def _unpack(data: bytes) -> list[bytes]:
    return data.split(BLANK) if data else []


PIECES = "bucket int, block int, words binary, counts binary, strings binary, string_counts binary"


def _piece(bucket: int, block: int, words: list[bytes], counts: np.ndarray, strings: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    data = {"words": _pack(words), "counts": counts.astype("<i8").tobytes(), "strings": strings.astype("<u8").tobytes(), "string_counts": sums.astype("<i8").tobytes()}
    return pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "block": pa.array([block], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in data.items()})


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _string_bucket(strings: np.ndarray, buckets: int) -> np.ndarray:
    """By the last three bytes of the context, mixed so that each of them tells in every bit."""
    mixed = ((strings >> np.uint64(8)) & MASKS[3]) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _count_task(buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is a block: its distinct words and strings with their training counts, packed by bucket."""
        seen: Counter = Counter()
        asked: set = set()
        tally, block = Tally(), None
        for batch in batches:
            lines: dict[bool, list[bytes]] = {False: [], True: []}
            for block, out, text in zip(batch["block"].to_pylist(), batch["held_out"].to_pylist(), batch["text"], strict=True):  # noqa: B007
                words = split_words(text.as_py())
                lines[out].append(BLANK.join(words))
                words.append(END)
                (asked if out else seen).update(words)
            for out, own in lines.items():
                for strings in strings_of(own):
                    distinct, counts = np.unique(strings, return_counts=True)
                    tally.add(distinct, np.zeros(len(distinct), np.int64) if out else counts)
        if block is None:
            return
        words = [*seen, *(asked - seen.keys())]
        counts = np.zeros(len(words), np.int64)
        counts[: len(seen)] = [*seen.values()]
        strings, sums = tally.sums()
        order, cuts = _by_bucket(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets, buckets)
        string_order, string_cuts = _by_bucket(_string_bucket(strings, buckets), buckets)
        for i in range(buckets):
            at, string_at = order[cuts[i] : cuts[i + 1]], string_order[string_cuts[i] : string_cuts[i + 1]]
            if len(at) or len(string_at):
                yield _piece(i, block, [words[j] for j in at], counts[at], strings[string_at], sums[string_at])
        del seen, asked, tally, words, strings, sums
        release()

    return task


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket and group of blocks, which follow each other: distinct words and strings with their counts over all."""
    for (bucket, block), rows in groupby(_rows(batches, ("bucket", "block", "words", "counts", "strings", "string_counts")), itemgetter(0, 1)):
        total: dict[bytes, int] = {}
        tally = Tally()
        for _, _, words, counts, strings, sums in rows:
            for word, n in zip(_unpack(words), np.frombuffer(counts, "<i8").tolist(), strict=True):
                total[word] = total.get(word, 0) + n
            tally.add(np.frombuffer(strings, "<u8"), np.frombuffer(sums, "<i8"))
        yield _piece(bucket, block, list(total), np.fromiter(total.values(), "<i8", len(total)), *tally.sums())


def _summed(pieces: DataFrame, blocks: int, buckets: int, fan: int) -> DataFrame:
    """A row a bucket, its block -1, by rounds of sums over `fan` blocks or sums each."""
    part = F.pmod(F.col("bucket") + F.col("block"), F.lit(buckets))
    while blocks > fan:
        blocks = -(-blocks // fan)
        dealt = pieces.withColumn("block", F.floor(F.col("block") / fan).cast("int")).repartitionById(buckets, part)
        pieces = materialize(dealt.sortWithinPartitions("bucket", "block").mapInArrow(_sum_task, PIECES))
    return materialize(pieces.withColumn("block", F.lit(-1)).repartitionById(buckets, "bucket").mapInArrow(_sum_task, PIECES))


def _middle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each bucket has of the strings of three bytes, a row a pair of bytes that these begin with; those only asked for count 0."""
    for bucket, strings, sums in _rows(batches, ("bucket", "strings", "string_counts")):
        own, n = grouped(np.frombuffer(strings, "<u8") & MASKS[3], np.frombuffer(sums, "<i8"))
        pairs, first = np.unique(own >> np.uint64(8), return_index=True)
        cuts = [*first.tolist(), len(own)]
        packed = [[x[i:j].astype(kind).tobytes() for i, j in zip(cuts, cuts[1:])] for x, kind in ((own, "<u8"), (n, "<i8"))]
        yield pa.record_batch([pa.array(pairs.tolist(), pa.int32()), pa.array([bucket] * len(pairs), pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["pair", "bucket", "strings", "string_counts"])


def _middle_sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each pair, which follow each other and are 256 at most: its strings of three bytes over all buckets, for each of these."""
    for _, rows in groupby(_rows(batches, ("pair", "bucket", "strings", "string_counts")), itemgetter(0)):
        _, to, strings, sums = zip(*rows, strict=True)
        whole, n = grouped(*(np.concatenate([np.frombuffer(x, kind) for x in own]) for own, kind in ((strings, "<u8"), (sums, "<i8"))))
        for bucket in to:
            yield _piece(bucket, -2, [], np.empty(0, np.int64), whole[n > 0], n[n > 0])


def _pair_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of two bytes with their counts, and in a row without one the number of tokens and of known words."""
    for batch in batches:
        for counts, strings, sums in zip(*(batch[c].to_pylist() for c in ("counts", "strings", "string_counts")), strict=True):
            counts, sums = np.frombuffer(counts, "<i8"), np.frombuffer(sums, "<i8")
            pairs, n = grouped(np.frombuffer(strings, "<u8")[sums > 0] & MASKS[2], sums[sums > 0])
            yield pa.record_batch({"pair": pa.array([None, *pairs.tolist()], pa.int32()), "n": pa.array([int(counts.sum()), *n.tolist()], pa.int64()), "kinds": pa.array([int((counts > 0).sum())] + [0] * len(pairs), pa.int64())})


SCORED = {"words": "binary", "known": "binary", "base": "binary", "strings": "binary", "cost": "binary"}


def _score_task(low, tokens: int, kinds: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket and group of blocks: the order two of its pairs, its vocabulary and its part of the trie, then what one block after another asks for."""
        for _, rows in groupby(_rows(batches, ("bucket", "part", "block", "words", "counts", "strings", "string_counts")), itemgetter(0, 1)):
            at: dict[bytes, int] = {}
            known = base = cost = np.zeros(0)
            table, middle = np.zeros(0, np.uint64), Tally()
            for _, _, block, words, counts, strings, sums in rows:
                words, strings = _unpack(words), np.frombuffer(strings, "<u8")
                if block == -2:
                    middle.add(strings, np.frombuffer(sums, "<i8"))
                    continue
                if block == -1:
                    at, counts = {w: i for i, w in enumerate(words)}, np.frombuffer(counts, "<i8")
                    known, base = (counts > 0).astype(np.uint8), np.log10((counts + 1) / (tokens + kinds + 1))
                    model, table = PpmModel(strings, np.frombuffer(sums, "<i8"), low.value, middle.sums()), strings
                    cost = np.concatenate([np.zeros(0), *(model.log10(table[i : i + STEP]) for i in range(0, len(table), STEP))])
                    continue
                places = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
                made = {"words": _pack(words), "known": known[places].tobytes(), "base": base[places].astype("<f8").tobytes(), "strings": strings.tobytes(), "cost": cost[np.searchsorted(table, strings)].astype("<f8").tobytes()}
                yield pa.record_batch({"block": pa.array([block], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in made.items()})

    return task


def _document_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition is a block: first its words and strings with what they cost, then its documents."""
    at: dict[bytes, int] = {}
    parts: dict[str, list] = {"known": [], "base": [], "strings": [], "cost": []}
    kinds = {"known": np.uint8, "base": "<f8", "strings": "<u8", "cost": "<f8"}
    known = base = cost = table = None
    for batch in batches:
        rows, lines = [], []
        columns = [batch[c].to_pylist() for c in SCORED]
        for i, (words, *own) in enumerate(zip(*columns, strict=True)):
            if words is not None:
                at.update(zip(_unpack(words), range(len(at), len(at) + len(own[0])), strict=True))
                for (k, held), data in zip(parts.items(), own, strict=True):
                    held.append(np.frombuffer(data, kinds[k]))
                continue
            if known is None:
                known, base, strings, cost = (np.concatenate(x) for x in parts.values())
                table = pa.array(strings)
                parts.clear()
            words = split_words(batch["text"][i].as_py())
            lines.append(BLANK.join(words))
            words.append(END)
            places = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            rows.append((i, len(words), int(known[places].sum(dtype=np.int64)), float(base[places].sum())))
        if rows:
            each = np.concatenate([cost[pc.index_in(pa.array(strings), value_set=table).to_numpy(zero_copy_only=False).astype(np.int64)] for strings in strings_of(lines)])
            sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
            scores = np.add.reduceat(each, np.cumsum(sizes) - sizes)
            taken = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch(
                [batch["id"].take(taken), batch["held_out"].take(taken), *(pa.array([r[j] for r in rows], kind) for j, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()))), pa.array(scores)],
                names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )
    at.clear()
    del parts, known, base, cost, table
    release()


def ppm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket: int = BUCKET, fan: int = FAN, spread: int = SPREAD) -> DataFrame:
    """Train on the rows where held_out is false and score all: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: its one token is the end. Rows may repeat, and ids too; equal texts have equal scores.
    With nothing to train on, every byte has 1/256 and the base 1. An empty table gives no rows.
    """
    spark = bound_batches(docs).sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, buckets = max(parts, -(-size // block)), max(parts, -(-size // bucket))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    pieces = materialize(rows.repartitionById(blocks, "block").mapInArrow(_count_task(buckets), PIECES))
    vocabulary = _summed(pieces, blocks, buckets, fan)
    pairs = vocabulary.mapInArrow(_pair_task, "pair int, n long, kinds long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).orderBy("pair").toArrow().to_pydict()
    tokens, kinds = (pairs["n"].pop(0), pairs["kinds"].pop(0)) if pairs["n"] else (0, 0)
    low = spark.sparkContext.broadcast((np.array(pairs["pair"][1:], np.uint64), np.array(pairs["n"], np.int64)))
    middle = vocabulary.mapInArrow(_middle_task, "pair int, bucket int, strings binary, string_counts binary").repartition(parts, "pair").sortWithinPartitions("pair")
    copies = vocabulary.unionByName(middle.mapInArrow(_middle_sum_task, PIECES)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // spread))))
    asking = pieces.withColumn("part", F.floor(F.col("block") / spread).cast("int")).unionByName(copies)
    asked = asking.repartitionById(buckets, F.pmod(F.col("bucket") + F.col("part"), F.lit(buckets))).sortWithinPartitions("bucket", "part", "block")
    scored = asked.mapInArrow(_score_task(low, tokens, kinds), "block int, " + ", ".join(f"{k} {v}" for k, v in SCORED.items()))
    nothing = F.lit(None).cast("binary")
    of_block = scored.select("block", F.lit(0).alias("after"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("boolean").alias("held_out"), nothing.alias("text"), *SCORED)
    lines = of_block.unionByName(rows.select("block", F.lit(1).alias("after"), "id", "held_out", "text", *[nothing.alias(c) for c in SCORED]))
    out = lines.repartitionById(blocks, "block").sortWithinPartitions("after").mapInArrow(_document_task, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
