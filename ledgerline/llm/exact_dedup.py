"""Exact dedup by skew-safe combining.

Rows with equal normalised text form a group. A task first combines its own rows, then rows of one salt meet by
digest, then the winners of all salts meet; each step groups by the digest and the full content, so texts whose
digests collide stay apart. No step holds the members of a group, only its winner and its size. Rows of a digest that
many have do not meet in one task when they are told their winner.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, join_groups, materialize

SALTS = 16


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Null text counts as empty text. The largest id of a group stays; null ids stay only if a group has no other, and
    rows that repeat the winning id are all marked as kept. Other columns are ignored, whatever their names. An empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("content")).withColumn("digest", digest(F.col("content")))
    # Spark combines within each task before this shuffle; a task's rows share one salt, so that step is complete.
    salted = rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "content", "salt").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    groups = salted.groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    # From here on only digests move; what a digest stands for is settled, unless several texts share it.
    groups = materialize(groups.select("digest", "keep_id", "group_size"))
    light = rows.select("id", "digest")
    shared = groups.groupBy("digest").count().filter("count > 1").select("digest")
    if shared.isEmpty():
        out = join_groups(light, groups, "digest", "group_size", "id")
    else:
        apart = rows.join(shared, "digest", "left_semi")
        full = apart.groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        out = join_groups(light.join(shared, "digest", "left_anti"), groups.join(shared, "digest", "left_anti"), "digest", "group_size", "id").unionByName(apart.join(full, ["digest", "content"]).drop("content"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
