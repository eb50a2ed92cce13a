"""SimHash near-duplicates with BK-trees.

Fingerprints that differ in at most two of four 16-bit blocks agree in two blocks, so each is sent to six shards, one
per pair of blocks and their 32 bits. A shard's distinct fingerprints form a BK-tree: children are keyed by their
Hamming distance to the parent, and a search follows only edges within the radius. Trees are not broadcast, as no bound
on their size is known; the fingerprints that a tree may link come to it instead. A shard above a size limit, as when
thousands of near copies crowd together, is linked in another exact way: two fingerprints differ in at most two bits
just when they share a neighbour at one bit or less, and no neighbour has more than 65 of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerline.llm.common import bound_batches, join_groups, materialize, texts_of
from ledgerline.llm.components import connected_components

RADIUS, SHINGLE, SEED, BITS = 2, 3, 42, 64
#: Fingerprints in a shard that a BK-tree takes.
TREE = 1000
#: Hashes of a text that are held as bits at once.
SLICE = 200_000


def fingerprint(text: str) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; zero for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes, these touch and split at ASCII alone
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = list(accumulate(len(x) + 1 for x in words))
    starts = [0, *ends[: n - 1]]
    cuts = map(slice, starts, (x - 1 for x in ends[min(SHINGLE, len(words)) - 1 :]))
    hashes = np.fromiter(map(xxh64_intdigest, map(line.__getitem__, cuts), repeat(SEED)), np.uint64, n)
    ones = sum(np.unpackbits(hashes[i : i + SLICE].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64) for i in range(0, n, SLICE))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp: a document's fingerprint as a signed 64-bit number. Null text counts as empty."""
    rows = bound_batches(docs.select(id_col, text_col))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in texts_of(batch[text_col])], np.uint64).view(np.int64)
            yield pa.record_batch([batch[id_col], pa.array(found)], names=["id", "fp"])

    return rows.mapInArrow(task, f"id {rows.schema[id_col].dataType.simpleString()}, fp long")


class BkTree:
    """Distinct fingerprints; children are keyed by their distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """The places of all values within the radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            stack.extend(child for key, child in self.children[at].items() if d - radius <= key <= d + radius)
        return found

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        own = len(self.values) - 1
        at = 0
        while at != own:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), own)
        return own


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join, within a shard, all values that any chain of links joins: one a value at most."""
    tree, top = BkTree(), []

    def root(at: int) -> int:
        while top[at] != at:
            top[at] = at = top[top[at]]
        return at

    for value in values:
        near = tree.within(value, radius)
        own = tree.add(value)
        top.append(own)
        for other in near:
            a, b = sorted((root(own), root(other)))
            top[b] = a
    return [(values[i], values[root(i)]) for i in range(len(values)) if root(i) != i]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _tree_task(radius: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may go on in the next batch."""
        shard, held, links = None, [], []

        def close():
            if len(held) > 1:
                links.extend(tree_links(held, radius))

        for batch in batches:
            for key, value in zip(batch["shard"].to_pylist(), batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64).tolist(), strict=True):
                if key != shard:
                    close()
                    shard, held = key, []
                held.append(value)
            if links:
                ends = _signed(np.array(links, np.uint64))
                yield pa.record_batch({"a": np.ascontiguousarray(ends[:, 0]), "b": np.ascontiguousarray(ends[:, 1])})
                links = []
        close()
        if links:
            ends = _signed(np.array(links, np.uint64))
            yield pa.record_batch({"a": np.ascontiguousarray(ends[:, 0]), "b": np.ascontiguousarray(ends[:, 1])})

    return task


def _shards(fp: Column) -> Column:
    """The six shards of a fingerprint, each a pair of its blocks."""
    block = [F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for k, (i, j) in enumerate(pairs)])


def links_within(values: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """values: distinct fp. Returns a, b: links whose chains join exactly the values that chains of near pairs join."""
    if radius != 2:
        raise ValueError("shards and shared neighbours are laid out for a radius of two bits")
    shards = values.select("fp", F.explode(_shards(F.col("fp"))).alias("shard"))
    counts = materialize(shards.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"))
    met = shards.join(counts, "shard")
    small = met.filter(F.col("n") <= tree).select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp")
    links = small.mapInArrow(_tree_task(radius), "a long, b long")
    crowded = met.filter(F.col("n") > tree).select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)]
    near = crowded.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("probe")).groupBy("probe").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return links.union(near.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """One row per input row: id, fp, fingerprint (16 hex digits), component_id: the smallest id in reach.

    Equal fingerprints are one node, so copies are counted once and not paired. Null or wordless texts have
    fingerprint zero and link like any other. Null ids name no component unless it has no other. Repeated rows each
    get their row. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col))
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    labels = connected_components(links_within(nodes.select("fp"), radius, tree))
    joined = nodes.join(labels.withColumnRenamed("node", "fp"), "fp")
    lowest = joined.groupBy("label").agg(F.min("low").alias("component_id"))
    wide = joined.join(lowest, "label").select("fp", "component_id")
    component = materialize(nodes.join(wide, "fp", "left").select("fp", "n", F.coalesce("component_id", "low").alias("component_id")))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_groups(rows, component, "fp", "n", "id").select(F.col("id").alias(id_col), "fp", hexed.alias("fingerprint"), "component_id")
