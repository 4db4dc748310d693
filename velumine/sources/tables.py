"""Loading of Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velumine.session import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
