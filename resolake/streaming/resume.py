"""Resumable processing: append what is not yet done, as a batch or as a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from ..operators.joining import first_wins


def done_keys(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Keys in the output so far, or None before the first run."""
    try:
        return spark.read.parquet(path).select(key).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append_new(batch: DataFrame, path: str, key: str, order: list[str], process: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """Process rows whose key the output lacks, keep the first of each key, and append them.

    Running a batch again adds nothing, so it may be retried after any failure.
    """
    one = first_wins(batch, [key], order)
    done = done_keys(batch.sparkSession, path, key)
    new = one if done is None else one.join(done, key, "left_anti")
    process(new).write.mode("append").parquet(path)


def _first_of_new(columns: list[str], order: list[str]):
    """For applyInPandasWithState: the first row of a key that no batch had before, after which the key's state says so."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for pdf in parts:
            best = pd.concat([best, pdf]) if best is not None else pdf
            best = best.sort_values(order, kind="stable").iloc[:1]
        state.update((True,))
        yield best[columns]

    return run


def stream_new(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, key: str, order: list[str], process: Callable[[DataFrame], DataFrame] = lambda x: x, files_per_batch: int = 50):
    """Start a query over new files of a folder, in micro-batches of so many files, until none are left.

    Keys that are done are state of the query, kept by key with its checkpoint,
    so a batch reads its own files only. A batch that failed runs again with the
    state and files that it had, and the sink takes each batch once. Rows with a
    null key count as one key. process must go row by row (no aggregates).
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    new = files.groupBy(key).applyInPandasWithState(_first_of_new(files.columns, order), files.schema, "done boolean", "append", GroupStateTimeout.NoTimeout)
    return process(new).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written there first if it is missing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
