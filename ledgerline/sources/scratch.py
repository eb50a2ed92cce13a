"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of this session, in the order in which they were named.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies under spark.checkpoint.dir, a path without a scheme in Spark's default file system. Only where that is unset
    and Spark runs in one process, as in tests, a temporary folder is set; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        context.setCheckpointDir(base)
    if not re.match("[A-Za-z][A-Za-z0-9+.-]*:/", base):
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    MADE.append(f"{base.rstrip('/')}/ledgerline-{uuid.uuid4().hex}")
    return MADE[-1]


def make_folder(spark: SparkSession, folder: str) -> None:
    """The folder, if it is not there yet: for files that tasks write, of which there may be none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete this session's scratch folders from a place in MADE on, but for the last `keep`; results that still read them are lost."""
    kept = MADE[max(since, len(MADE) - keep) :]
    for folder in MADE[since : len(MADE) - len(kept)]:
        delete_folder(spark, folder)
    MADE[since:] = kept


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
