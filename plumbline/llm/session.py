"""What the operators need from the session; shared with the rest of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.shared import Scratch, shared_dir, shared_path, ship, written

__all__ = ["Scratch", "shared_dir", "shared_path", "ship", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
