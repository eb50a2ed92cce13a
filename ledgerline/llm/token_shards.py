"""Token ids in binary shard files, each a wavelet matrix.

A shard holds the ids of consecutive documents as bit-planes: plane k has bit k (from the top) of each token's place in
the shard's own alphabet, and each next plane is ordered by the bits before it, zeros first. With the counts of ones
before every 512th bit, a token is read, counted or found from about log2(alphabet) words of 64 bytes, which are read
from their place in the file: the rest stays unread.

Layout, little-endian: 8 bytes magic; uint64 tokens, uint32 symbols, uint32 planes, uint64 documents, uint64 documents
without an id, which come first; the symbols (uint32, ascending); zeros of each plane (uint64); for each plane the ones
before each block (uint64, and in all) and then its bits, padded to 64 bytes; then, zstd-compressed, the documents'
token counts (uint32) and ids (int64).
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.bpe import UnitCache, byte_letters
from ledgerline.llm.common import bound_batches, file_system, make_folder, materialize, release, write_file

MAGIC = b"WAVETOK2"
HEAD = "<8sQIIQQ"
BLOCK = 512
#: Bits of a plane that are worked on together, as they fit a core's cache.
STEP = 1 << 16
#: A file is closed once it holds so many tokens.
SHARD_TOKENS = 8_000_000


class WaveletMatrix:
    """A sequence of symbols by bit-planes with rank and select."""

    def __init__(self, symbols: np.ndarray, zeros: list[int], planes: list, n: int, ones: list | None = None):
        """planes and ones: arrays, or what gives arrays for slices."""
        self.symbols, self.zeros, self.planes, self.n = symbols, zeros, planes, n
        if ones is not None:
            self._ones = ones

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        """tokens: unsigned integers below 2**32."""
        used = np.bincount(tokens) if len(tokens) else np.zeros(0, np.int64)
        symbols = np.flatnonzero(used).astype(np.uint32)
        place = np.zeros(len(used), np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        place[symbols] = np.arange(len(symbols))
        row = place[tokens] if len(tokens) else np.zeros(0, np.uint16)
        zeros, planes = [], []
        for bit in reversed(range(max(1, (len(symbols) - 1).bit_length()) if len(symbols) else 0)):
            ones = (row & (1 << bit)).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            planes.append(np.concatenate((packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8))))
            zeros.append(len(row) - int(np.count_nonzero(ones)))
            then, low, high = np.empty_like(row), 0, zeros[-1]
            for start in range(0, len(row), STEP):
                part, here = row[start : start + STEP], ones[start : start + STEP]
                down, up = np.compress(~here, part), np.compress(here, part)
                then[low : low + len(down)], then[high : high + len(up)] = down, up
                low, high = low + len(down), high + len(up)
            row = then
        return cls(symbols, zeros, planes, len(tokens))

    def tokens(self) -> np.ndarray:
        """The whole sequence, plane by plane from the last: each plane's order is undone by its own bits, some at a time."""
        row = np.zeros(self.n, np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
        for bit, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            back, low, high = np.empty_like(row), 0, zeros
            for start in range(0, self.n, STEP):
                part, here = back[start : start + STEP], ones[start : start + STEP]
                up, down = np.flatnonzero(here), np.flatnonzero(~here)
                part[down] = row[low : low + len(down)]
                part[up] = row[high : high + len(up)] | (1 << bit)
                low, high = low + len(down), high + len(up)
            row = back
        return self.symbols[row] if self.n else self.symbols[:0]

    @functools.cached_property
    def _ones(self) -> list[np.ndarray]:
        return [np.concatenate(([0], np.cumsum(np.bitwise_count(p.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)))) for p in self.planes]

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block, rest = divmod(i, BLOCK)
        bits = int.from_bytes(self.planes[k][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)].tobytes(), "little") & ((1 << rest) - 1)
        return int(self._ones[k][block]) + bits.bit_count()

    def _select(self, k: int, one: bool, j: int) -> int:
        """Where plane k has its j-th (from 0) one or zero."""
        ones = self._ones[k][:]
        before = ones if one else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[j - int(before[block])])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = 0
        for k in range(len(self.planes)):
            ones = self._rank1(k, i)
            bit = self._rank1(k, i + 1) - ones
            place = place << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return int(self.symbols[place])

    def _span(self, symbol: int, end: int) -> tuple[int, int] | None:
        """Where the occurrences of a symbol before end stand below the last plane."""
        place = int(np.searchsorted(self.symbols, symbol))
        if place == len(self.symbols) or self.symbols[place] != symbol:
            return None
        start = 0
        for k in range(len(self.planes)):
            a, b = self._rank1(k, start), self._rank1(k, end)
            if place >> (len(self.planes) - 1 - k) & 1:
                start, end = self.zeros[k] + a, self.zeros[k] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, symbol: int, end: int | None = None) -> int:
        """How often a symbol occurs before end."""
        span = self._span(symbol, self.n if end is None else end)
        return span[1] - span[0] if span else 0

    def select(self, symbol: int, j: int) -> int:
        """Where a symbol occurs for the j-th time, from 0."""
        span = self._span(symbol, self.n)
        if not span or not 0 <= j < span[1] - span[0]:
            raise IndexError(j)
        at, place = span[0] + j, int(np.searchsorted(self.symbols, symbol))
        for k in reversed(range(len(self.planes))):
            one = bool(place >> (len(self.planes) - 1 - k) & 1)
            at = self._select(k, one, at - self.zeros[k] if one else at)
        return at


def dump(tokens: np.ndarray, counts: np.ndarray, ids: list[int | None] | None = None) -> Iterator[bytes]:
    """The parts of a shard file: all tokens, each document's number of them, and its id; documents without one come first."""
    matrix = WaveletMatrix.build(tokens)
    ids = list(range(len(counts))) if ids is None else ids
    named = [x for x in ids if x is not None]
    if ids != [None] * (len(ids) - len(named)) + named:
        raise ValueError("documents without an id come first")
    yield struct.pack(HEAD, MAGIC, matrix.n, len(matrix.symbols), len(matrix.planes), len(counts), len(ids) - len(named))
    yield matrix.symbols.astype("<u4").tobytes()
    yield np.array(matrix.zeros, "<u8").tobytes()
    for ones, plane in zip(matrix._ones, matrix.planes, strict=True):
        yield ones.astype("<u8").tobytes()
        yield plane.tobytes()
    yield zstandard.compress(counts.astype("<u4").tobytes() + np.array(named, "<i8").tobytes())


class _Ranged:
    """An array in a file, of which slices are read."""

    def __init__(self, file, at: int, kind: str, length: int):
        self.file, self.at, self.kind, self.length = file, at, np.dtype(kind), length

    def __getitem__(self, i: int | slice):
        start, stop, _ = (slice(i, i + 1) if isinstance(i, int) else i).indices(self.length)
        self.file.seek(self.at + start * self.kind.itemsize)
        got = np.frombuffer(self.file.read((stop - start) * self.kind.itemsize), self.kind)
        return got[0] if isinstance(i, int) else got


def header(file) -> tuple[int, int, int, int, int]:
    """tokens, symbols, planes, documents, documents without an id."""
    file.seek(0)
    magic, *sizes = struct.unpack(HEAD, file.read(struct.calcsize(HEAD)))
    if magic != MAGIC:
        raise ValueError("not a token shard")
    return tuple(sizes)


def open_matrix(file) -> tuple[WaveletMatrix, int]:
    """The matrix of an open shard file, whose planes are read as they are asked for, and where its documents begin."""
    n, symbols, planes, _, _ = header(file)
    at = struct.calcsize(HEAD)
    names, zeros = _Ranged(file, at, "<u4", symbols)[:], _Ranged(file, at + 4 * symbols, "<u8", planes)[:].tolist()
    at += 4 * symbols + 8 * planes
    blocks = -(-n // BLOCK)
    ones, rows = [], []
    for _ in range(planes):
        ones.append(_Ranged(file, at, "<u8", blocks + 1))
        rows.append(_Ranged(file, at + 8 * (blocks + 1), "u1", blocks * (BLOCK // 8)))
        at = rows[-1].at + rows[-1].length
    return WaveletMatrix(names, zeros, rows, n, ones), at


def load(file) -> tuple[WaveletMatrix, np.ndarray, list[int | None]]:
    """The whole matrix of an open shard file, its documents' token counts and their ids."""
    matrix, at = open_matrix(file)
    matrix.planes, matrix._ones = [x[:] for x in matrix.planes], [x[:] for x in matrix._ones]
    _, _, _, documents, nameless = header(file)
    file.seek(at)
    rest = zstandard.decompress(file.read(), max_output_size=max(1, 12 * documents))
    counts = np.frombuffer(rest, "<u4", documents)
    return matrix, counts, [None] * nameless + np.frombuffer(rest, "<i8", documents - nameless, 4 * documents).tolist()


class LibraryCache(UnitCache):
    """Encodes units with the tokenizers library; a text's units are encoded as they are in the whole text."""

    remember, slice = 1_500_000, 6_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        spelled = {b: c for c, b in byte_letters().items()}
        self.letters = {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(256)}
        self.plain = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        super().__init__()

    def packed(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of plain letters are one piece each and go to the tokenizer's model at once; others take the whole way."""
        found: list = [None] * len(units)
        rest, tokenize, letters, plain = [], self.model.tokenize, self.letters, self.plain
        for i, unit in enumerate(units):
            if plain(unit):
                found[i] = [t.id for t in tokenize(unit.translate(letters))]
            else:
                rest.append(i)
        for start in range(0, len(rest), 50_000):
            part = rest[start : start + 50_000]
            encoded = self.tokenizer.encode([units[i] for i in part], is_pretokenized=True, add_special_tokens=False)
            ids, ends = encoded.ids, np.cumsum(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(part))).tolist()
            for i, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
                found[i] = ids[a:b]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


@functools.lru_cache(maxsize=2)
def library(path: str) -> LibraryCache:
    """One tokenizer a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryCache(path)


def write_token_shards(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all texts and write their ids, each document's followed by end_id, in ascending id order.

    Returns file, n_tokens, n_docs. Null text counts as empty, null ids come first, rows with one id follow each other by
    text. A task holds one file's tokens and writes it under a name that a repeated attempt replaces; names are in the
    order of the ids. An empty table gives no file.
    """
    rows = bound_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).repartitionByRange("id").sortWithinPartitions("id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = library(path), TaskContext.get().partitionId()
        held, ids, size, number = [], [], 0, 0

        def close():
            name = f"{folder}/tokens-{part:08d}-{number:08d}.wav"
            write_file(name, dump(np.concatenate(held), np.array([len(x) for x in held]), ids))
            return pa.record_batch({"file": [name], "n_tokens": pa.array([size], pa.int64()), "n_docs": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for doc, made in zip(batch["id"].to_pylist(), coder.encode_array(batch["text"]), strict=True):
                held.append(np.append(made, np.uint32(end_id)))
                ids.append(doc)
                size += len(held[-1])
                if size >= shard_tokens:
                    yield close()
                    held, ids, size, number = [], [], 0, number + 1
        if held:
            yield close()
            held.clear()
        release()

    make_folder(docs.sparkSession, folder)
    return materialize(rows.mapInArrow(task, "file string, n_tokens long, n_docs long"))


def _header_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = []
        for name in batch["path"].to_pylist():
            fs, path = file_system(name)
            with fs.open_input_file(path) as f:
                sizes.append(header(f)[0])
        yield pa.record_batch({"file": batch["path"], "n_tokens": pa.array(sizes, pa.int64())})


def read_token_shards(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document of a folder's files: doc_id, start, n_tokens, ids_crc32, and tokens unless left out.

    All comes from the files and the order of their names; crc32 is taken over token ids as little-endian unsigned
    32-bit integers. First headers alone are read, for how many ids are before each file.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")
    sizes = materialize(names.repartition(tasks, "path").mapInArrow(_header_task, "file string, n_tokens long"))
    before = Window.orderBy(F.element_at(F.split("file", "/"), -1)).rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = materialize(sizes.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch["file"].to_pylist(), batch["first"].to_pylist(), strict=True):
                fs, path = file_system(name)
                with fs.open_input_file(path) as f:
                    matrix, counts, docs = load(f)
                tokens = matrix.tokens().astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                starts, data = ends - counts, memoryview(tokens).cast("B")
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = {"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts + first), "n_tokens": pa.array(counts.astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64())}
                if with_ids:
                    columns["tokens"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(tokens.astype(np.int64)))
                yield pa.record_batch(columns)

    return files.repartition(tasks, "file").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", tokens array<long>" * with_ids)
