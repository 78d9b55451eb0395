"""The driver's tables, and folders for what is written on the way."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}  # by application: the folder of a session on one machine that names none


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a local folder stands in on a single machine only."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="resolake-"))


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its cluster with it
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.globStatus(where if path.endswith("/") else where.suffix("*")) or []:
            files.delete(found.getPath(), True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there, or under names that begin so, is removed when Python ends."""
    path = f"{shared_dir(spark)}/resolake-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def release(df: DataFrame) -> None:
    """Remove the kept tables that a result reads, once it is no longer needed; a service that runs long calls this for each result."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.fullmatch(r"resolake-[0-9a-f]{32}-kept-\d+", folder.rsplit("/", 1)[1]):
            _remove(df.sparkSession, f"{folder}/")


class Scratch:
    """Tables that one operator call computes once and reads again, as Parquet in the shared folder.

    They cut lineage, survive lost executors and are read in splits by bytes.
    On leaving they are removed, but for kept ones, which the result may still
    have to read: those go when Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/resolake-{uuid.uuid4().hex}", 0

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def table(self, df: DataFrame) -> DataFrame:
        return self._write(df, self.folder())

    def drop(self, df: DataFrame) -> None:
        """Remove a table before the others."""
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            _remove(self.spark, f"{path}/")

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}-kept-{self.made}"
        self.made += 1
        atexit.register(_remove, self.spark, path)
        return self._write(df, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self.made:
            _remove(self.spark, f"{self.root}/")
