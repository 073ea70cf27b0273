"""What several operators of this folder use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwright.functions.storage import cut, delete, released, scratch, shared_dir, written

__all__ = ["cut", "delete", "read_table", "released", "scratch", "shared_dir", "written"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
