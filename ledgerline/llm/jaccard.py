"""Near copies by the Jaccard similarity of word shingles, verified on the full sets.

A text is the set of its shingles' 64-bit hashes; equal sets are one node. Candidates come first from SimHash fingerprints
that BK-trees link within two bits (`simhash.py`): what their chains join is one bucket. As such fingerprints agree for the
nearest copies alone, MinHash bands give the rest: two sets of similarity s share one of BANDS bands of ROWS minima with
probability 1 - (1 - s**ROWS)**BANDS, at 0.8 all but 3 in a million. Every candidate pair of both is verified by exact
intersection, so no pair below the similarity is linked.

No pair is a row. A bucket is dealt to blocks of a bounded size; within a block a task joins what chains of similar sets
join, and the many bands deal the sets of a large group anew each time, so that it comes out joined. Sets of buckets
whose blocks stay apart, as texts of one template that are not similar enough, are known by their rarest hashes: of two
similar sets each has one among so few of its rarest that texts which share frequent parts alone have none in common.
Sets with a rare hash that few have meet by that. Only sets with one that many have, outside of their bucket's largest
component, are compared with all blocks of the bucket. So the result is the same as if every candidate pair were
verified. Work grows with the square of a group only where the rarest fifth of the hashes of many dissimilar texts is
common to many.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from ledgerline.llm.common import bound_batches, join_groups, materialize, release, texts_of
from ledgerline.llm.components import connected_components, merge_components
from ledgerline.llm.simhash import fingerprint, links_within

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 4
#: Shingles whose hashes are permuted at once.
SLICE = 2048
#: Sets and hashes of a block, and the sets of a bucket that is known by them.
BLOCK_SETS, BLOCK_HASHES, FEW = 256, 1_000_000, 32
#: Parts in which the sets that have a hash are counted.
PARTS = 256
_random = np.random.default_rng(SEED)
FLIPS = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
FACTORS = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending. A text of fewer words is one shingle."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes, these touch and split at ASCII alone
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, (words[i : i + shingle] for i in range(n)))
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the least values of its permuted hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), SLICE):
        np.minimum(least, ((hashes[i : i + SLICE] ^ FLIPS) * FACTORS).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)), np.uint64, BANDS)


def _keys_task(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch["text"])
        sets = [shingle_set(x, shingle) for x in texts]
        if sets:
            nodes = np.fromiter((_node(s) for s in sets), np.uint64, len(sets)).view(np.int64)
            prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            keys = np.concatenate([band_keys(s) for s in sets]).view(np.int64)
            sizes = np.array([len(s) for s in sets], np.int32)
            yield pa.record_batch([batch["id"], batch["text_key"], pa.array(nodes), pa.array(sizes), pa.array(prints), _lists(keys, np.full(len(sets), BANDS))], names=["id", "text_key", "node", "size", "fp", "keys"])
        del texts, sets
    release()


def _sets_task(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x, shingle) for x in texts_of(batch["text"])]
        if sets:
            nodes = np.fromiter((_node(s) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.record_batch([pa.array(nodes), _lists(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]))], names=["node", "hashes"])
        del sets
    release()


def _node(hashes: np.ndarray) -> int:
    return xxh64_intdigest(hashes.tobytes(), SEED)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), pa.array(values))


def _shared(found: np.ndarray, hashes: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
    """How many of the found hashes each owner has, of hashes in ascending order with their owners."""
    low, high = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
    each = high - low
    ends = np.cumsum(each)
    return np.bincount(owners[np.repeat(low - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)], minlength=count)


class _Sets:
    """Some sets as one ascending list of hashes with their owners."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        hashes, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.listed = hashes[order], owners[order], len(sets)

    def near(self, found: np.ndarray, similarity: float) -> np.ndarray:
        """Which sets have the similarity with this one."""
        shared = _shared(found, self.hashes, self.owners, len(self.sets))
        return shared / (len(found) + self.sizes - shared) >= similarity

    def keep(self, some: np.ndarray) -> None:
        """Only some sets are asked for from now on; what is listed of the others goes once it is most."""
        if 2 * np.count_nonzero(some) < self.listed:
            own = some[self.owners]
            self.hashes, self.owners, self.listed = self.hashes[own], self.owners[own], int(np.count_nonzero(some))


def block_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links by place that join what any chain of similar sets joins: fewer than there are sets.

    From each set those in reach are found in turn, each time among the sets that are not reached yet.
    """
    table, left, links = _Sets(sets), np.ones(len(sets), bool), []
    for root in range(len(sets)):
        stack = [root] * bool(left[root])
        left[root] = False
        while stack and left.any():
            at = stack.pop()
            table.keep(left)
            near = np.flatnonzero(table.near(sets[at], similarity) & left)
            left[near] = False
            stack += near.tolist()
            links += [(at, i) for i in near.tolist()]
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[list[list]]:
    """Consecutive rows of equal keys, as lists of the other columns and of their hashes as arrays."""
    where, held = None, None
    for batch in batches:
        places = zip(*(batch[k].to_pylist() for k in keys), strict=True)
        hashes = batch["hashes"].combine_chunks() if isinstance(batch["hashes"], pa.ChunkedArray) else batch["hashes"]
        values, ends = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))
        for i, (place, *own) in enumerate(zip(places, *(batch[c].to_pylist() for c in columns), strict=True)):
            if place != where:
                if held is not None:
                    yield held
                where, held = place, [[] for _ in range(len(columns) + 1)]
            for x, y in zip(held, [*own, values[ends[i - 1] if i else 0 : ends[i]].copy()], strict=True):
                x.append(y)
    if held is not None:
        yield held


LINKS = "a long, b long"


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def _block_task(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and block."""
    found = []
    for nodes, sets in _groups(batches, ("key", "block"), ("node",)):
        if len(nodes) > 1:
            found += [(nodes[a], nodes[b]) for a, b in block_links(sets, similarity)]
        if len(found) > 10_000:
            yield _pairs(found)
            found = []
    if found:
        yield _pairs(found)
    release()


def _rest_task(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and block, the block's own before those that ask: links between different components."""
    for nodes, labels, asks, sets in _groups(batches, ("key", "block"), ("node", "label", "asks")):
        own = [i for i, a in enumerate(asks) if not a]
        if own:
            table, names, found = _Sets([sets[i] for i in own]), np.array([labels[i] for i in own]), []
            for i in (i for i, a in enumerate(asks) if a):
                found += [(nodes[i], nodes[own[j]]) for j in np.flatnonzero(table.near(sets[i], similarity) & (names != labels[i])).tolist()]
            if found:
                yield _pairs(found)


def _deal(keys: DataFrame, block_sets: int, block_hashes: int) -> DataFrame:
    """keys: node, size, key. A written table of key, blocks, block, node of the keys that several sets have."""
    buckets = materialize(keys.groupBy("key").agg(F.count("*").alias("sets"), F.sum("size").alias("hashes")).filter("sets > 1"))
    blocks = F.greatest(F.ceil(F.col("sets") / block_sets), F.ceil(F.col("hashes") / block_hashes)).cast("int")
    met = materialize(keys.join(buckets, "key").select("key", "node", "sets", blocks.alias("blocks")))
    # Sets that meet by several keys meet once, if a key has no others: its nodes are few, and name it.
    few = (F.col("sets") <= FEW) & (F.col("blocks") == 1)
    small = met.filter(few).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).groupBy("nodes").agg(F.min("key").alias("key"))
    small = small.select("key", F.lit(1).alias("blocks"), F.lit(0).alias("block"), F.explode("nodes").alias("node"))
    large = met.filter(~few).select("key", "blocks", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int").alias("block"), "node")
    return materialize(small.unionByName(large))


def _links_within(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    placed = members.select("key", "block", "node").join(sets, "node").repartition("key", "block").sortWithinPartitions("key", "block")
    return materialize(placed.mapInArrow(partial(_block_task, similarity=similarity), LINKS).distinct())


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of keys with several blocks and several components, with their label and the key's largest component: written."""
    named = members.filter("blocks > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", "n").alias("largest"), F.count("*").alias("labels"))
    return materialize(named.join(sizes.filter("labels > 1").select("key", "largest"), "key"))


def _hashes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes: node, label, asks, once each. A row a node and hash, as its key."""
    return sets.join(nodes, "node").select("node", "label", "asks", F.size("hashes").alias("size"), F.explode("hashes").alias("key"))


def _rare_keys(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rarest hashes of the nodes that ask, of those that sets of several components have: node, key, n, total.

    Two sets of a similarity have so many hashes in common that of each one's rarest hashes, in one order of all and but
    for those that may be missing from the other, they share one. n sets, of total hashes, have the hash.
    """
    # A key's sets are counted in parts, so that no part of a common one is long; a part holds its asking sets meanwhile.
    salt = F.pmod(F.xxhash64("node"), F.lit(PARTS)).alias("part")
    asking = F.collect_list(F.when(F.col("asks"), F.struct("node", "size"))).alias("asking")
    parts = _hashes(nodes, sets).groupBy("key", salt).agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"), asking)
    every = Window.partitionBy("key")
    counted = parts.select("key", "asking", *[f(c).over(every).alias(c) for c, f in (("n", F.sum), ("total", F.sum), ("low", F.min), ("high", F.max))])
    ranked = counted.select(F.explode("asking").alias("own"), "key", "n", "total", "low", "high").select("own.*", "key", "n", "total", "low", "high").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("n", "key")))
    rarest = ranked.filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * (similarity - 1e-9)) + 1)
    return materialize(rarest.filter("low <> high").select("node", "key", "n", "total"))


def _asking(apart: DataFrame) -> DataFrame:
    """Sets outside of their key's largest component, once for each of its blocks."""
    return apart.filter("label <> largest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))


def _links_between(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    asking = _asking(apart.filter("asks")).withColumn("asks", F.lit(1))
    asked = apart.join(asking.select("key").distinct(), "key", "left_semi").withColumn("asks", F.lit(0))
    both = asked.unionByName(asking).select("key", "block", "asks", "node", "label")
    return materialize(both.join(sets, "node").repartition("key", "block").sortWithinPartitions("key", "block", "asks").mapInArrow(partial(_rest_task, similarity=similarity), LINKS))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block_sets: int = BLOCK_SETS, block_hashes: int = BLOCK_HASHES
) -> DataFrame:
    """One row per input row: id, node, component_id: the smallest id that chains of similar texts reach.

    Ids may be of any type with an order, a struct too. Null text counts as empty; texts without words are equal. Null
    ids name no component unless it has no other. Repeated rows each get their row. An empty table gives no rows.
    """
    # Sets are made again for candidates alone, whose texts are found by a hash: so only theirs are written.
    texts = bound_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")))
    rows = materialize(texts.mapInArrow(partial(_keys_task, shingle=shingle), StructType([texts.schema["id"], *StructType.fromDDL("text_key long, node long, size int, fp long, keys array<long>")])))
    nodes = materialize(rows.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("keys").alias("keys")))
    chained = connected_components(links_within(nodes.select("fp").distinct())).select(F.col("node").alias("fp"), "label")
    chain = F.xxhash64(F.lit("simhash"), F.coalesce("label", "fp"))
    bands = nodes.join(chained, "fp", "left").select("node", "size", F.explode(F.concat("keys", F.array(chain))).alias("key"))
    members = _deal(bands, block_sets, block_hashes)
    candidates = materialize(nodes.select("node", "text_key").join(members.select("node").distinct(), "node", "left_semi").select("text_key").distinct())
    found = texts.select("text", "text_key").join(candidates, "text_key", "left_semi").select("text")
    sets = materialize(found.mapInArrow(partial(_sets_task, shingle=shingle), "node long, hashes array<long>").dropDuplicates(["node"]))
    labels = connected_components(_links_within(members, sets, similarity))
    apart = _apart(members, labels)
    if not apart.isEmpty():
        apart_nodes = materialize(apart.groupBy("node", "label").agg(F.max(F.col("label") != F.col("largest")).alias("asks")))
        rare, few = _rare_keys(apart_nodes, sets, similarity), (F.col("n") <= FEW) & (F.col("total") <= block_hashes)
        met = _hashes(apart_nodes, sets).join(rare.filter(few).select("key").distinct(), "key", "left_semi").select("node", "size", "key")
        labels = merge_components(labels, _links_within(_deal(met, block_sets, block_hashes), sets, similarity))
        asks = materialize(rare.filter(~few).select("node", F.lit(True).alias("asks")).distinct())
        apart = _apart(members, labels).join(asks, "node", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        if not apart.filter("asks").isEmpty():
            labels = merge_components(labels, _links_between(apart, sets, similarity))
    joined = nodes.select("node", "low").join(labels, "node")
    lowest = joined.groupBy("label").agg(F.min("low").alias("component_id"))
    wide = joined.join(lowest, "label").select("node", "component_id")
    component = materialize(nodes.select("node", "n", "low").join(wide, "node", "left").select("node", "n", F.coalesce("component_id", "low").alias("component_id")))
    return join_groups(rows.select("id", "node"), component, "node", "n", "id").select(F.col("id").alias(id_col), "node", "component_id")
