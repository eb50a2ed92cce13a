"""Files in shared storage, joins of hot keys and text helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.scratch import MADE, clear_scratch, make_folder, materialize, shared_dir  # noqa: F401

#: The upper-case and lower-case letters that normalisation maps, and nothing beyond them.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = str.maketrans(UPPER, LOWER)
#: Fixed value: what counts as a word. Only space and U+0009 to U+000D separate words.
WORD = r"[^\x20\x09-\x0D]+"


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """rows with the other columns of groups, which has each row's key once and in `size` how many rows have it.

    A key with over a thousandth of the rows is hot. There are fewer than a thousand of them, so they are broadcast, and
    their rows go on by their column `spread` instead of meeting in one task.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    names = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) * 1000 > total).select(F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot"))
    known = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").drop("_hot_key")
    known = known.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(1024)).cast("int") + 1))
    # A plain 0 would be taken out of the join's keys.
    cold = groups.select(key, F.when(F.col(size) > 0, 0).otherwise(-1).alias("_salt"), F.struct(*names).alias("_own"))
    met = known.join(cold, [key, "_salt"], "left").withColumn("_own", F.coalesce("_hot", "_own"))
    return met.select(*rows.columns, *[F.col(f"_own.{c}").alias(c) for c in names])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def file_system(uri: str):
    """The file system of a shared folder and the path in it, for files that tasks write or read in ranges."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def write_file(uri: str, parts) -> None:
    """Write a file under a name of this attempt's own and move it to its name: attempts never mix."""
    files, path = file_system(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    files.move(own, path)


#: Bytes of an Arrow batch of texts, about; the usual limit of rows alone lets long texts add up.
BATCH_BYTES = 12 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """For work on whole texts in Python: has the session keep Arrow batches within BATCH_BYTES, unless it has a lower bound."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name)
    if not now.isdecimal() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def release() -> None:
    """Give memory that a task has done with back to the system, as the Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The column as strings, null as empty."""
    return [x or "" for x in column.to_pylist()]
