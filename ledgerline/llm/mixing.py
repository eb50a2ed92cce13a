"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a hash, and the blocks are permuted. A source's target fixes how many of
its permuted blocks the mix draws, whole passes first. The drawn blocks of all sources are then dealt to output shards
by halving: the left half of the shards gets a multivariate-hypergeometric share of what its node holds, and so on down
to single shards, so each shard's block counts are a uniform draw without replacement. A shard's quota is a run of the
permuted draws that no other shard has, and documents are shuffled within the shard. Only built-in functions are used;
all arrays hold block numbers of one source or sources of one node, never documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, materialize

BLOCKS = 4096
#: Words of an output shard, about, and the least blocks that shards get on average.
SHARD_WORDS, SHARD_BLOCKS = 20_000_000, 16
MOST = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that the parts alone decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / float(16**12)


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    Weights are 1, 2, 3, repeating over the sources by code point, null last. Targets share the sum of all sizes by
    weight; none exceeds most times its source, and the excess goes to the others by weight. The window runs over one
    row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    share = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("place", F.row_number().over(by_ratio)).select(
        "source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(share * F.col("weight"), F.col("cap"))).alias("target")
    )


def block_draws(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """The draws of each source: an array of (block, pass) in permuted order.

    Whole passes take every block. Of the rest, blocks are taken in permuted order while they fit, and then the one
    block that brings the sum nearest to the target, if any does. At most BLOCKS entries a source and pass.
    """
    arrays = blocks.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("place", "block", "words"))).alias("blocks"))
    joined = arrays.join(targets, arrays.source.eqNullSafe(targets.source)).drop(targets.source)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    start = F.struct((F.col("target") - F.col("passes") * F.col("source_size")).alias("left"), F.array().cast("array<int>").alias("taken"))
    fitted = F.aggregate(
        "blocks",
        start,
        lambda a, x: F.when(
            (x["words"] > 0) & (x["words"] <= a["left"]),
            F.struct((a["left"] - x["words"]).alias("left"), F.concat(a["taken"], F.array(x["block"])).alias("taken")),
        ).otherwise(a),
    )
    spare = F.filter("blocks", lambda x: (x["words"] > 0) & (x["words"] < 2 * F.col("fit.left")) & ~F.array_contains(F.col("fit.taken"), x["block"]))
    nearest = F.array_min(F.transform("spare", lambda x: F.struct(F.abs(F.col("fit.left") - x["words"]).alias("off"), x["place"].alias("place"), x["block"].alias("block"))))["block"]
    return (
        joined.withColumn("passes", passes)
        .withColumn("fit", fitted)
        .withColumn("spare", spare)
        .withColumn("extra", F.when(F.size("spare") > 0, F.concat(F.col("fit.taken"), F.array(nearest))).otherwise(F.col("fit.taken")))
        .withColumn(
            "draws",
            F.concat(
                F.flatten(F.transform(F.sequence(F.lit(0), F.col("passes")), lambda p: F.when(p < F.col("passes"), F.transform("blocks", lambda x: F.struct(x["block"].alias("block"), p.alias("pass")))).otherwise(F.array().cast("array<struct<block:int,pass:int>>")))),
                F.transform("extra", lambda b: F.struct(b.alias("block"), F.col("passes").alias("pass"))),
            ),
        )
        .select("source", "source_size", "target", "draws")
    )


def _hypergeometric(u: Column, rest: Column, n: Column, free: Column) -> Column:
    """How many of n blocks are among the `free` that are drawn of `rest` in all: by inversion, u in [0, 1) deciding.

    Outcomes are gone through from the likeliest one upwards, then downwards from it, each weight from the one before,
    first for their sum and then for the place of u. So many steps are taken that what is left out weighs less than u
    can tell (twelve standard deviations).
    """
    off = rest - n - free
    most = F.least(n, (F.sqrt(n) * 6 + 12).cast("long"))
    likeliest = F.greatest(F.least(n, free, F.floor((n + 1) * (free + 1) / (rest + 2))), -off, F.lit(0)).cast("long")

    def start(place: Column) -> Column:
        fields = {"n": n, "free": free, "off": off, "mode": likeliest, "most": most, "place": place, "weight": F.lit(0.0), "sum": F.lit(0.0), "got": F.lit(None).cast("long")}
        return F.struct(*[x.alias(k) for k, x in fields.items()])

    def step(s, i):
        k = F.when(i <= s["most"], s["mode"] + i).otherwise(s["mode"] + s["most"] - i)
        rise = (s["n"] - k + 1) * (s["free"] - k + 1) / (k * (s["off"] + k))
        fall = (k + 1) * (s["off"] + k + 1) / ((s["n"] - k) * (s["free"] - k))
        weight = F.when(i == 0, 1.0).when(i <= s["most"], s["weight"] * rise).when(i == s["most"] + 1, fall).otherwise(s["weight"] * fall)
        same = [s[c].alias(c) for c in ("n", "free", "off", "mode", "most", "place")]
        got = F.when(s["got"].isNull() & (s["sum"] + weight > s["place"]), k).otherwise(s["got"])
        return F.struct(*same, weight.alias("weight"), (s["sum"] + weight).alias("sum"), got.alias("got"))

    steps = F.sequence(F.lit(0).cast("long"), most * 2 + 1)
    total = F.aggregate(steps, start(F.lit(float("inf"))), step)["sum"]
    return F.aggregate(steps, start(u * total), step)["got"]


def _left_share(seed: str, level: int):
    """For the fold over a node's sources: draws the left child's blocks of one source after another."""

    def share(held, x):
        u = _unit(F.lit(seed), F.lit(level), F.col("node"), F.size(held["left"]))
        got = _hypergeometric(u, held["rest"], x["n"], held["free"])
        return F.struct((held["rest"] - x["n"]).alias("rest"), (held["free"] - got).alias("free"), F.concat(held["left"], F.array(got)).alias("left"))

    return share


def shard_quotas(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """quotas: source, quota (blocks). Returns source, shard, quota, first: the run of the source's draws a shard gets.

    A node holds block counts by source for its range of shards; its left child draws as many blocks as its share of
    the shards asks for, without replacement, each block of the node as likely as any other. Nodes of a level are rows
    of their own; one holds a number a source, and a draw takes steps with the root of it. shards is a power of two.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    one = F.transform(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "quota"))), lambda x: F.struct(x["source"].alias("source"), x["quota"].cast("long").alias("n")))
    node = quotas.agg(one.alias("held")).select(F.lit(0).alias("node"), "held")
    for level in range(shards.bit_length() - 1):
        total = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        state = F.struct(total.alias("rest"), F.floor(total / 2).cast("long").alias("free"), F.array().cast("array<bigint>").alias("left"))
        node = node.withColumn("left", F.aggregate("held", state, _left_share(seed, level))["left"]).select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.zip_with("held", "left", lambda x, n: F.struct(x["source"].alias("source"), n.alias("n"))).alias("held")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("held", "left", lambda x, n: F.struct(x["source"].alias("source"), (x["n"] - n).alias("n"))).alias("held")),
                )
            ).alias("x")
        ).select("x.node", "x.held")
        node = materialize(node)
    rows = node.select(F.col("node").alias("shard"), F.explode("held").alias("x")).select("shard", "x.source", F.col("x.n").alias("quota"))
    run = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum("quota").over(run), F.lit(0).cast("long")))


def _hashed(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long")


def block_of(id_column: Column, blocks: int = BLOCKS, seed: str = SEED) -> Column:
    """The block of a document within its source; null ids share one."""
    return (_hashed(F.lit(seed), F.coalesce(id_column.cast("string"), F.lit("null"))) % blocks).cast("int")


def _key(id_column: Column, number: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), id_column.cast("string"), number.cast("string")))


def shards_for(words: float, blocks: int) -> int:
    """The number of output shards: a power of two, as SHARD_WORDS and SHARD_BLOCKS ask for; two at least."""
    wanted = min(words / SHARD_WORDS, blocks / SHARD_BLOCKS)
    return max(2, 1 << math.ceil(math.log2(max(1, wanted))))


def plan_mix(rows: DataFrame, blocks: int = BLOCKS, shards: int | None = None, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """rows: source, block, size. Returns the sources (source, source_size, weight, target) and the draws of their blocks
    (source, block, copies: an array of pass and shard). A block that is not drawn has no row. The number of shards
    follows from the targets unless it is given."""
    grouped = materialize(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    sources = materialize(source_targets(grouped.groupBy("source").agg(F.sum("words").alias("source_size"))))
    placed = grouped.withColumn("place", _hashed(F.lit(seed), F.lit("block"), F.col("block").cast("string")))
    draws = materialize(block_draws(placed, sources))
    drawn = draws.agg(F.sum("target"), F.sum(F.size("draws"))).first()
    runs = shard_quotas(draws.select("source", F.size("draws").alias("quota")), shards or shards_for(drawn[0] or 0, drawn[1] or 0), seed)
    slots = draws.select("source", F.posexplode("draws").alias("slot", "draw")).select("source", "slot", "draw.block", "draw.pass")
    seats = runs.filter("quota > 0").select(F.col("source").alias("of"), "shard", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("seat"))
    dealt = slots.join(seats, F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("seat")))
    return sources, materialize(dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("copies")))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS, shards: int | None = None, seed: str = SEED
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target and draws, an array of (pass, shard, key).

    Each entry of draws is one copy in the mix; key orders the copies of a shard at random. Null text has size 0, null
    sources are one source, repeated rows are drawn together, null ids share one block. An empty table gives no rows.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), block_of(F.col(id_col), blocks, seed).alias("block")))
    sources, taken = plan_mix(rows, blocks, shards, seed)
    out = _null_safe_left(_null_safe_left(rows, taken, ["source", "block"]), sources.drop("weight"), ["source"])
    copies = F.coalesce("copies", F.array().cast("array<struct<pass:int,shard:int>>"))
    draws = F.transform(copies, lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), _key(F.col("id"), x["pass"], seed).alias("key")))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", draws.alias("draws"))


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS, shards: int | None = None, seed: str = SEED
) -> DataFrame:
    """The mix: each input row once for each of its draws, with mix_shard, mix_pass and mix_key added or replaced.

    Rows meet the draws of their block, which are few beside the rows, so texts move only if those are not broadcast.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = own.withColumn("block", block_of(F.col("id"), blocks, seed))
    _, taken = plan_mix(rows.select("source", "block", word_count(F.col("text")).alias("size")), blocks, shards, seed)
    draws = taken.select(F.col("source").alias("of"), F.col("block").alias("its"), F.explode("copies").alias("draw"))
    met = rows.join(draws, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("its")))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("mix_shard", "mix_pass", "mix_key")]
    return met.select(*kept, F.col("draw.shard").alias("mix_shard"), F.col("draw.pass").alias("mix_pass"), _key(F.col("id"), F.col("draw.pass"), seed).alias("mix_key"))


def _null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select([F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"_{k}" for k in keys])


def emit_shards(mixed: DataFrame) -> DataFrame:
    """The mix in the order of its output shards, shuffled within each; a large shard takes several tasks."""
    return mixed.repartitionByRange("mix_shard", "mix_key").sortWithinPartitions("mix_shard", "mix_key")
