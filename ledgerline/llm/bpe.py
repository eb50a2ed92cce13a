"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a prefix ends in one token, and that last token alone says how the prefix is cut: what stands before it
is encoded as that shorter prefix is. So a trie of the distinct words needs one state a node. Going depth-first, a
node's last token is the one token that its path ends with and that follows on the state at its start, which holds if
the two tokens, put together, are still encoded as these two. Prefixes that words share are computed once.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ledgerline.llm.common import bound_batches, release

#: Fixed value: what the byte-level pre-tokenizer cuts a text into.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: white space.
SPACE = "\t-\r \x85\xa0  -     　"
#: Distinct units that a generation remembers, and characters of text that it works on at once.
REMEMBER, SLICE = 1_000_000, 3_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable bytes for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class UnitCache:
    """Encodes texts by their units: a text is cut at blanks between words, where no piece goes on, and each distinct
    unit is encoded once; subclasses say how. Arrow splits, numbers and looks up the units, so Python sees new ones
    only. What is remembered is bounded: when it is full, the units not met again since they came go."""

    remember, slice = REMEMBER, SLICE

    def __init__(self):
        self.uneven = f"[{SPACE}] | [{SPACE}]"
        self.even_space = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.begins, self.lengths, self.hits = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def tokens(self, units: list[str]) -> list[tuple[int, ...]]:
        raise NotImplementedError

    def packed(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units one after another, and each unit's number of them."""
        found = self.tokens(units)
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _drop(self) -> None:
        keep = np.flatnonzero(self.hits)
        lengths, begins = self.lengths[keep], self.begins[keep]
        ends = np.cumsum(lengths)
        self.flat = self.flat[np.repeat(begins - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self.known = self.known.take(pa.array(keep))
        self.begins, self.lengths, self.hits = ends - lengths, lengths, np.zeros(len(keep), bool)

    def _tails(self, words: pa.Array) -> np.ndarray:
        """Where in the cache the ids of words with a blank before them are."""
        if len(self.known) > self.remember:
            self._drop()
            if len(self.known) > self.remember // 2:
                self._forget()
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.hits[at[at >= 0]] = True
        new = np.flatnonzero(at < 0)
        if len(new):
            strings = words.take(pa.array(new))
            flat, lengths = self.packed([" " + x for x in strings.to_pylist()])
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.begins = np.concatenate((self.begins, np.cumsum(lengths) - lengths + len(self.flat)))
            self.lengths, self.hits = np.concatenate((self.lengths, lengths)), np.concatenate((self.hits, np.zeros(len(new), bool)))
            self.known, self.flat = pa.concat_arrays([self.known, strings]), np.concatenate((self.flat, flat))
        return at

    def _units(self, texts: pa.Array) -> pa.ListArray:
        odd = np.asarray(pc.match_substring_regex(texts, self.uneven).to_numpy(zero_copy_only=False), bool)
        if not odd.any():
            return pc.split_pattern(texts, " ")
        by_hand = pa.array([self.even_space.split(x) for x in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        order = np.empty(len(texts), np.int64)
        order[np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))] = np.arange(len(texts))
        return pa.concat_arrays([pc.split_pattern(texts.filter(pa.array(~odd)), " "), by_hand]).take(pa.array(order))

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's number of them. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        units = self._units(texts)
        ends = np.cumsum(units.value_lengths().to_numpy())
        heads = np.concatenate(([0], ends[:-1]))
        numbered = units.flatten().dictionary_encode()
        words, number = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
        own, back = np.unique(number[heads], return_inverse=True)
        number[heads] = len(words) + back
        used = np.zeros(len(words) + len(own), bool)
        used[number] = True
        tails = np.flatnonzero(used[: len(words)])
        at = self._tails(words.take(pa.array(tails)))
        head_flat, head_lengths = self.packed(words.take(pa.array(own)).to_pylist())
        begins, lengths = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
        begins[tails], lengths[tails] = self.begins[at], self.lengths[at]
        begins[len(words) :], lengths[len(words) :] = len(self.flat) + np.cumsum(head_lengths) - head_lengths, head_lengths
        each = lengths[number]
        place = begins[number] - (np.cumsum(each) - each)
        flat = np.concatenate((self.flat, head_flat))
        return flat[np.repeat(place, each) + np.arange(int(each.sum()))], np.add.reduceat(each, heads)

    def encode_array(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, working on `slice` characters at a time."""
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(sizes, self.slice + (sizes[start - 1] if start else 0), side="right")))
            flat, counts = self.encode_flat(texts.slice(start, end - start))
            ends = np.cumsum(counts)
            yield from (flat[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True))
            start = end

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        return (x.tolist() for x in self.encode_array(pa.array(texts, pa.string())))


class BpeCodec(UnitCache):
    """Encodes and decodes with the vocabulary and merges of a tokenizer file; holds nothing of the texts but a bounded cache."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        letters, model = byte_letters(), spec["model"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        special_ids = set(self.special.values())
        self.ids = {b: i for i, b in self.bytes_of.items() if i not in special_ids}
        self.sizes = {i: len(b) for i, b in self.bytes_of.items()}
        have = {len(b) for b in self.ids}
        self.spans = [[n for n in range(span, 0, -1) if n in have] for span in range(max(have) + 1)]
        self.names = {i: str(i) for i in self.bytes_of}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.whole: dict[int, bool] = {}
        self.follows: dict[int, bool] = {}
        self.pieces = regex.compile(PIECES)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        super().__init__()

    def merged(self, text: bytes) -> list[int]:
        """The encoding of a few bytes by the merges themselves: the lowest rank first, from the left."""
        ids = [self.ids[bytes([b])] for b in text]
        while len(ids) > 1:
            found = min(((m[0], i, m[1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))), default=None)
            if not found:
                break
            ids[found[1] : found[1] + 2] = [found[2]]
        return ids

    def _whole(self, token: int) -> bool:
        self.whole[token] = known = self.merged(self.bytes_of[token]) == [token]
        return known

    def _follows(self, first: int, second: int) -> bool:
        self.follows[first << 32 | second] = known = self.merged(self.bytes_of[first] + self.bytes_of[second]) == [first, second]
        return known

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """Distinct words into a trie, then the last-token states of its nodes depth-first, and each word's tokens.

        The trie is its own depth-first listing: the words in order, each with the depth that it shares with the word
        before it. Below that depth its nodes are new; above it the states on the way down still hold.
        """
        listing, before = [], b""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            listing.append((word, shared))
            before = word
        ids, lengths, whole, follows, spans = self.ids.get, self.sizes, self.whole, self.follows, self.spans
        longest = len(spans) - 1
        state = [0]
        for word, shared in listing:
            del state[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                for length in spans[depth if depth < longest else longest]:
                    token = ids(word[depth - length : depth])
                    if token is None:
                        continue
                    if length == depth:
                        known = whole.get(token)
                        if known is None:
                            known = self._whole(token)
                    else:
                        earlier = state[depth - length]
                        known = follows.get(earlier << 32 | token)
                        if known is None:
                            known = self._follows(earlier, token)
                    if known:
                        state.append(token)
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
            at, out = len(word), []
            while at:
                out.append(state[at])
                at -= lengths[state[at]]
            yield word, tuple(out[::-1])

    def _recalled(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Of pieces that begin with a blank, those that the cache has as units; a look-up pays for many only."""
        if len(pieces) * 50 < len(self.known):
            return {}
        at = pc.fill_null(pc.index_in(pa.array([x[1:] for x in pieces], pa.string()), value_set=self.known), -1).to_numpy(zero_copy_only=False)
        return {pieces[i]: tuple(self.flat[(b := self.begins[at[i]]) : b + self.lengths[at[i]]].tolist()) for i in np.flatnonzero(at >= 0).tolist()}

    def tokens(self, units: list[str]) -> list[tuple[int, ...]]:
        find, special = self.pieces.findall, self.special
        cut = []
        for unit in units:
            if self.cut_special and self.cut_special.search(unit):
                cut.append([w for x in self.cut_special.split(unit) if x for w in ([special[x]] if x in special else find(x))])
            else:
                cut.append(find(unit))
        distinct = {w for words in cut for w in words if isinstance(w, str)}
        of: dict = {i: (i,) for i in special.values()} | self._recalled([w for w in distinct if w[0] == " " and len(w) > 1])
        distinct.difference_update(of)
        encoded = {w: w.encode("utf-8", "replace") for w in distinct}
        made = dict(self.encode_words(list(set(encoded.values()))))
        of |= {w: made[b] for w, b in encoded.items()}
        return [tuple(chain.from_iterable(map(of.__getitem__, words))) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One codec a Python worker."""
    return BpeCodec(path)


#: What bpe_columns can return, by name: type and how it is made from a text's ids.
OUTPUTS = {
    "ids": ("array<int>", lambda c, ids: ids),
    "decoded": ("string", lambda c, ids: c.decode(ids)),
    "n_tokens": ("bigint", lambda c, ids: len(ids)),
    "ids_sha256": ("string", lambda c, ids: hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest()),
    "decoded_sha256": ("string", lambda c, ids: hashlib.sha256(c.decode(ids).encode()).hexdigest()),
}
_ARROW = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "bigint": pa.int64()}


def bpe_columns(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: the id and the named outputs.

    Null text counts as empty: no ids, empty text. Rows may repeat; each is one output row. Other columns are not
    read. An empty table gives no rows.
    """
    rows = bound_batches(docs.select(id_col, text_col))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        makers = [OUTPUTS[x][1] for x in outputs]
        for batch in batches:
            made = [[f(coder, ids.tolist()) for f in makers] for ids in coder.encode_array(batch[text_col])]
            columns = [pa.array(x, _ARROW[OUTPUTS[k][0]]) for x, k in zip(zip(*made, strict=True), outputs, strict=True)] if made else [pa.array([], _ARROW[OUTPUTS[k][0]]) for k in outputs]
            yield pa.record_batch([batch[id_col], *columns], names=[id_col, *outputs])
        release()

    return rows.mapInArrow(task, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{x} {OUTPUTS[x][0]}" for x in outputs))


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids; null ids give null."""
    kept = encoded.select(*[c for c in encoded.columns if c != to])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch[ids_col].to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return kept.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{to}` string")
