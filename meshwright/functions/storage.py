"""What is written on the way: to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only in local mode, where one machine does everything, is one of our own set
    if the session names none; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named:
        if known.isDefined():
            return known.get()
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        _delete_at_exit(spark, named)
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    return path


@contextmanager
def released(spark: SparkSession):
    """Queries made in here delete their shuffle files when they have run.

    Else the files stay until the driver happens to collect its garbage: all steps
    of a long job lie on the executors' disks at once.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the copy: lineage ends there, and what was shuffled for it is deleted."""
    shared_dir(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # select: the setting holds for frames made under it


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: for wide rows, which a checkpoint would not compress."""
    path = scratch(df.sparkSession, what)
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    files, where = _place(spark, path)
    files.deleteOnExit(where)


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _place(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    files, where = _place(spark, path)
    files.delete(where, True)
