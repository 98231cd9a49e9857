"""Reading the project's Parquet tables and picking current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``folder``; projection and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_rows(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order`` columns (nulls lowest).

    Ties on every order column are broken by the kept values themselves, so the
    result doesn't depend on row order. Rows with a null key are dropped. The
    aggregation combines map-side, so a hot key costs one partial row per task.
    """
    picked = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in keep])).alias("picked__")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(picked)
        .select(key, *[F.col(f"picked__.{c}").alias(c) for c in keep])
    )
