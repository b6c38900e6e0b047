"""What the operators share: written intermediate tables and table reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strophe.sources.workspace import fresh_folder as fresh_path
from strophe.sources.workspace import materialize

__all__ = ["fresh_path", "materialize", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
