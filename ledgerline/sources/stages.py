"""Runs of named stages that a later run can take up again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame], DataFrame]


def _done(spark: SparkSession, path: str) -> str | None:
    """What a finished stage was made of, by the note beside it, which is written last."""
    try:
        return spark.read.text(f"{path}_made").first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_stages(spark: SparkSession, rows: DataFrame, stages: list[tuple[str, Stage]], folder: str, made_of: dict, resume: bool = True) -> DataFrame:
    """Each stage's result is written to the folder and is what the next one reads; the last one's is returned.

    made_of tells the input and the parameters. A stage that a run with the same made_of and the same stages before it
    has finished is not run again; one whose making differs is, with all after it.
    """
    note = hashlib.sha256(json.dumps(made_of, sort_keys=True, default=str).encode()).hexdigest()
    fresh = resume
    for name, stage in stages:
        path, note = f"{folder.rstrip('/')}/{name}", hashlib.sha256(f"{note}/{name}".encode()).hexdigest()
        fresh = fresh and _done(spark, path) == note
        if not fresh:
            stage(spark, rows).write.mode("overwrite").parquet(path)
            spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_made")
        rows = spark.read.parquet(path)
    return rows
