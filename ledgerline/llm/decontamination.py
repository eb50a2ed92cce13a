"""Benchmark decontamination by generalised suffix automata.

The words of the test items stand in suffix automata, whose states are all runs of words that any item has. A document's
words are streamed through one while the length of the longest run that ends at each word is kept. Where it is a
window's length or more, the window that ends there is found; items shorter than a window are found whole, as states
above the one that is reached.

Items are dealt to automata of a bounded number of words, each a file in the shared folder, which tasks load one at a
time; long items are cut into pieces that overlap by all but one word of a window. Documents do not move.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerline.llm.common import LOWER_TABLE, bound_batches, file_system, release, shared_dir, texts_of, write_file

WINDOW = 10
#: Words of an automaton and of a piece of an item.
BLOCK, PIECE = 200_000, 50_000
#: Bytes of a text, and words of a batch, that are worked on at once.
SLICE = 1 << 22
#: Of ASCII, digits and letters are parts of words, and upper-case letters count as lower-case ones.
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes(LOWER_TABLE.get(b, b) if b < 128 else b for b in range(256)))


def plain(text: str) -> bytes:
    """The text with one space for each byte that is in no word, so that places stay."""
    return text.encode("utf-8", "replace").translate(_BYTES)


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a plain text, in slices."""
    start = 0
    while start < len(data):
        end = len(data) if len(data) - start <= SLICE else data.find(b" ", start + SLICE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


class _Builder:
    """A suffix automaton of several runs of words: transitions, suffix links, and the longest run of each state."""

    def __init__(self) -> None:
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.go) - 1

    def _exact(self, at: int, word: int) -> int:
        """The state of at's longest run with the word after it, parted from longer runs if it shares their state."""
        found = self.go[at][word]
        if self.length[found] == self.length[at] + 1:
            return found
        parted = self._state(self.length[at] + 1, dict(self.go[found]), self.link[found])
        self.link[found] = parted
        while at >= 0 and self.go[at].get(word) == found:
            self.go[at][word] = parted
            at = self.link[at]
        return parted

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            if word in self.go[last]:
                last = self._exact(last, word)
                continue
            new, at = self._state(self.length[last] + 1, {}, 0), last
            while at >= 0 and word not in self.go[at]:
                self.go[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._exact(at, word)
            last = new


def build_automaton(pieces: list[tuple[int, list[bytes]]], ids: list[str], window: int = WINDOW) -> bytes:
    """The file of an automaton over pieces, each with the place of its item in ids."""
    vocabulary: dict[bytes, int] = {}
    coded = [(item, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for item, words in pieces]
    builder = _Builder()
    for _, words in coded:
        builder.add(words)
    tops, named = _tops(builder.link, builder.length, window), set()
    for item, words in coded:
        at = 0
        for i, word in enumerate(words, 1):
            at = builder.go[at][word]
            if i >= window:
                named.add((tops[at], item))
        if len(words) < window:
            named.add((at, item))
    n = len(vocabulary)
    steps = np.array(sorted((at * n + word, to) for at, go in enumerate(builder.go) for word, to in go.items()), np.int64).reshape(-1, 2)
    pairs = np.unique(np.array([a * n + b for _, words in coded for a, b in pairwise(words)], np.int64))
    text = lambda x: np.frombuffer(x, np.uint8)
    out = io.BytesIO()
    np.savez(
        out, vocabulary=text(b" ".join(vocabulary)), ids=text(json.dumps(ids).encode()), steps=steps, pairs=pairs, link=np.array(builder.link), length=np.array(builder.length),
        named=np.array(sorted(named), np.int64).reshape(-1, 2), shortest=np.array(min(window, min(len(w) for _, w in pieces))), window=np.array(window),
    )
    return out.getvalue()


def _tops(link: list[int], length: list[int], window: int) -> list[int]:
    """For each state of runs of a window's length or more, the state of their last window; else -1."""
    tops = [-1] * len(link)
    for at in np.argsort(length, kind="stable").tolist():
        if length[at] >= window:
            tops[at] = at if length[link[at]] < window else tops[link[at]]
    return tops


class Automaton:
    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as f:
            stored = {k: f[k] for k in f.files}
        words = stored["vocabulary"].tobytes().split()
        self.vocabulary, self.n = dict(zip(words, range(len(words)), strict=True)), len(words)
        self.go = dict(stored["steps"].tolist())
        self.link, self.length, self.pairs = stored["link"].tolist(), stored["length"].tolist(), stored["pairs"]
        self.window, self.shortest = int(stored["window"]), int(stored["shortest"])
        self.tops, ids = _tops(self.link, self.length, self.window), json.loads(stored["ids"].tobytes())
        self.items: dict[int, list[str | None]] = {}
        for state, item in stored["named"].tolist():
            self.items.setdefault(state, []).append(ids[item])
        # The nearest state, from each up, of a whole item that is shorter than a window.
        self.whole = [-1] * len(self.link)
        for at in np.argsort(self.length, kind="stable").tolist()[1:]:
            self.whole[at] = at if self.length[at] < self.window and at in self.items else self.whole[self.link[at]]

    def ids(self, data: bytes) -> list[np.ndarray]:
        """The numbers of a plain text's words; -1 for those that no item has."""
        return [np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words)) for words in words_of(data)]

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where runs of words lie whose every two neighbours are neighbours in an item: no window lies outside of them."""
        known, joined = ids >= 0, np.zeros(len(ids), bool)  # joined to the word before
        for start in range(1, len(ids), SLICE):
            end = min(start + SLICE, len(ids))
            at = start + np.flatnonzero(known[start:end] & known[start - 1 : end - 1])
            keys = ids[at - 1].astype(np.int64) * self.n + ids[at]
            place = np.searchsorted(self.pairs, keys)
            place[place == len(self.pairs)] = 0
            joined[at] = self.pairs[place] == keys if len(self.pairs) else False
        starts = np.flatnonzero(~joined & known)
        ends = np.append(np.flatnonzero(~joined), len(ids))
        ends = ends[np.searchsorted(ends, starts, "right")]
        long = ends - starts >= self.shortest
        return zip(starts[long].tolist(), ends[long].tolist(), strict=True)

    def stream(self, ids: list[int], base: int, starts: list[int], ends: list[int], states: set[int]) -> int:
        """Adds where windows that occur in the words start and end, and their states. Returns the longest match."""
        at = length = longest = 0
        for i, word in enumerate(ids, base + 1):
            to = self.go.get(at * self.n + word)
            while to is None and at:
                at = self.link[at]
                length = self.length[at]
                to = self.go.get(at * self.n + word)
            if to is None:
                continue
            at, length = to, length + 1
            longest = max(longest, length)
            if length >= self.window:
                starts.append(i - self.window)
                ends.append(i)
                states.add(self.tops[at])
            whole = self.whole[at]
            if whole == at and length < self.length[at]:
                whole = self.whole[self.link[at]]
            while whole > 0:
                starts.append(i - self.length[whole])
                ends.append(i)
                states.add(whole)
                whole = self.whole[self.link[whole]]
        return longest


@lru_cache(maxsize=2)
def _load(uri: str) -> Automaton:
    files, path = file_system(uri)
    with files.open_input_file(path) as f:
        return Automaton(f.read())


def write_automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> list[str]:
    """Automata over all items as files in the shared folder, each of at most `block` words and a piece, and their names.

    Items without words are left out; so is a null text. Rows that share an id are one item to those who count items.
    """
    spark, folder = items.sparkSession, shared_dir(items.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ids, held = [], [], 0

        def write() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.npz"
            write_file(uri, [build_automaton(pieces, ids, window)])
            return pa.record_batch([pa.array([uri])], names=["uri"])

        for batch in batches:
            for name, text in zip(batch["id"].to_pylist(), texts_of(batch["text"]), strict=True):
                words = [w for some in words_of(plain(text)) for w in some]
                for start in range(0, max(1, len(words) - window + 1) if words else 0, PIECE - window + 1):
                    piece = words[start : start + PIECE]
                    if held and held + len(piece) > block:
                        yield write()
                        pieces, ids, held = [], [], 0
                    pieces.append((len(ids), piece))
                    ids.append(name)
                    held += len(piece)
        if pieces:
            yield write()

    rows = bound_batches(items).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartition(max(1, size // (8 * block)))
    return sorted(r["uri"] for r in dealt.mapInArrow(task, "uri string").collect()) if size else []


def _hits(texts: list[bytes], automata: list[str]) -> tuple[np.ndarray, np.ndarray, list[set], list[int]]:
    """Of plain texts: how many words each has, which of all words are hit, and each one's items and longest match."""
    items, longest, hit, counts = [set() for _ in texts], [0] * len(texts), None, None
    for uri in automata:
        automaton = _load(uri)
        apart = np.full(1, -1, np.int32)
        coded = [automaton.ids(t) for t in texts]
        counts = np.array([sum(map(len, c)) for c in coded], np.int64)
        # A number that no item has stands after each text, so that no run goes on into the next.
        ids = np.concatenate([x for c in coded for x in (*c, apart)])
        del coded
        firsts = np.concatenate(([0], np.cumsum(counts + 1)))
        starts, ends, found = [], [], {}
        for start, end in automaton.runs(ids):
            doc = int(np.searchsorted(firsts, start, "right")) - 1
            longest[doc] = max(longest[doc], automaton.stream(ids[start:end].tolist(), start, starts, ends, found.setdefault(doc, set())))
        edges = np.bincount(starts, minlength=len(ids) + 1) - np.bincount(ends, minlength=len(ids) + 1) if starts else np.zeros(len(ids) + 1, np.int64)
        own = np.cumsum(edges)[:-1] > 0
        hit = own if hit is None else hit | own
        for doc, states in found.items():
            items[doc].update(i for s in states for i in automaton.items[s] if i is not None)
    if counts is None:
        counts = np.array([sum(map(len, words_of(t))) for t in texts], np.int64)
        hit = np.zeros(int(counts.sum()) + len(texts), bool)
    return counts, hit, items, longest


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words: the first and the one after the last."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


FOUND = "n_words long, n_hit long, longest long, items array<string>, spans array<struct<start:long,end:long>>"


def _scan(batches: Iterator[pa.RecordBatch], automata: list[str], schema: pa.Schema, cut: Callable | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch["text"].to_pylist()
        texts = [plain(t or "") for t in raw]
        if not texts:
            continue
        counts, hit, items, longest = _hits(texts, automata)
        firsts = np.concatenate(([0], np.cumsum(counts + 1))).tolist()
        spans = [_spans(hit[a : a + n]) if names else [] for a, n, names in zip(firsts, counts.tolist(), map(bool, longest), strict=False)]
        n_hit = [sum(b - a for a, b in s) for s in spans]
        out = {"row": batch["row"], "n_words": counts, "n_hit": n_hit, "longest": [x if n else 0 for x, n in zip(longest, n_hit, strict=True)], "items": [sorted(x) for x in items], "spans": [[{"start": a, "end": b} for a, b in s] for s in spans]}
        if cut:
            out["text"] = [cut(*x) for x in zip(raw, texts, spans, strict=True)]
        yield pa.record_batch([x if isinstance(x, pa.Array | pa.ChunkedArray) else pa.array(x, schema.field(k).type) for k, x in out.items()], names=list(out))
        del texts, raw
    release()


def _scanned(rows: DataFrame, automata: list[str], cut: Callable | None = None) -> DataFrame:
    schema = StructType([rows.schema["row"], *StructType.fromDDL(FOUND + ", text string" * bool(cut))])
    types = to_arrow_schema(schema)
    return bound_batches(rows).mapInArrow(lambda b: _scan(b, automata, types, cut), schema)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit, longest, items, spans.

    Words are runs of ASCII letters and digits, lower-cased, and of all characters beyond ASCII. Windows are the runs
    of `window` words of each item, and whole items of fewer; words inside any occurrence of one are hit. spans are the
    runs of hit words (first, one after the last), longest the longest run of words that is in any item (pieces of very
    long items count as items), 0 where none is hit; items the distinct ids, as strings and in their order, of items
    with windows that occur. Null text has no words; a null item id is named nowhere, but its windows hit. Rows that
    repeat an id each get their row. No items, or none with words, hit nothing; an empty table gives no rows.
    """
    automata = write_automata(items, item_id_col, item_text_col, window)
    return _scanned(docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), automata).withColumnRenamed("row", id_col)


_WORD = re.compile(rb"[^ ]+")


def _cutter(least: int, most: float) -> Callable:
    def cut(text: str | None, data: bytes, spans: list[tuple[int, int]]) -> str | None:
        """The text without its spans of at least so many words; null if more than the given share of all words is hit."""
        if not spans:
            return text
        if sum(b - a for a, b in spans) > most * sum(map(len, words_of(data))):
            return None
        edges = {i for a, b in spans if b - a >= least for i in (a, b - 1)}
        at = {i: m.span() for i, m in enumerate(_WORD.finditer(data)) if i in edges}
        whole, kept, end = text.encode("utf-8", "replace"), [], 0
        for a, b in (s for s in spans if s[1] - s[0] >= least):
            kept.append(whole[end : at[a][0]])
            end = at[b - 1][1]
        return b"".join([*kept, whole[end:]]).decode()

    return cut


def remove_contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least_words: int = WINDOW, most_share: float = 0.5
) -> DataFrame:
    """docs, all columns, with hit spans of at least least_words words cut out of the text.

    Documents of which more than most_share of the words is hit go altogether. Shorter spans stay, as do the bytes
    around a span, null texts and repeated rows. An empty table gives no rows.
    """
    automata = write_automata(items, item_id_col, item_text_col, window)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    done = _scanned(rows, automata, _cutter(least_words, most_share)).filter((F.col("n_hit") == 0) | F.col("text").isNotNull())
    return done.select([F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
