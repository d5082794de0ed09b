"""Parquet tables by name, and repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table `name` below sf_dir; with columns, only those are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest_delivery(df: DataFrame, key: str, order: str = "arrived_at") -> DataFrame:
    """One row per key: the one delivered last.

    Deliveries are reduced before the shuffle, so a key delivered very often costs no more than one row a
    partition. Rows whose key is null count as one key. Ties in `order` are broken by the row's own values,
    so the choice does not depend on the order of the input.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.max(F.struct(F.col(order), *[F.col(f"`{c}`") for c in rest])).alias("_best"))
    return best.select(key, *[F.col(f"_best.`{c}`").alias(c) for c in df.columns if c != key])
