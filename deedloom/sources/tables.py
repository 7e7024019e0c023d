"""Readers for the parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table, reduced to ``columns`` when given, so that the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def first_load(df: DataFrame, *key: str) -> DataFrame:
    """One row per key: redelivered rows repeat the values, so any row serves; ``loaded_at`` becomes the earliest.

    The aggregation combines on the map side, which keeps hot keys cheap. Null keys form a group of their own.
    """
    rest = [c for c in df.columns if c not in (*key, "loaded_at")]
    earliest = F.struct(F.col("loaded_at").isNull(), "loaded_at")  # a null time is late, not nothing
    picked = F.min_by(F.struct(*rest), earliest) if rest else None
    out = df.groupBy(*key).agg(
        *([picked.alias("_row")] if rest else []), F.min("loaded_at").alias("loaded_at")
    )
    return out.select(*key, *([F.col(f"_row.{c}").alias(c) for c in rest]), "loaded_at")
