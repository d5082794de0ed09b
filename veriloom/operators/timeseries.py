"""Joins and groupings over time that Spark has no operator for. Not part of the record pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """left with the value of the latest right row of the same keys at or before its time; null if there is none.

    One union and one window by key instead of a join by inequality; a key's rows are streamed through the window.
    Of right rows at one time the greatest value counts.
    """
    r = right.groupBy(*by, at).agg(F.max(value).alias("_v")).select(*by, at, F.lit(0).alias("_side"), "_v", F.lit(None).alias("_row"))
    row = F.struct(*[F.col(c) for c in left.columns])
    r = r.withColumn("_row", F.lit(None).cast(left.select(row.alias("x")).schema["x"].dataType))
    both = left.select(*by, at, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), row.alias("_row")).unionByName(r)
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select("_row.*", value)


def range_join(left: DataFrame, right: DataFrame, by: list[str], at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Inner join of points with intervals lo <= at < hi: both are put into buckets of `width`, intervals into all they touch."""
    b = lambda c: F.floor(F.col(c) / width)
    r = right.withColumn("_b", F.explode(F.sequence(b(lo), b(hi))))
    return left.withColumn("_b", b(at)).join(r, [*by, "_b"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_b")


def sessions(df: DataFrame, by: list[str], at: str, gap_s: int) -> DataFrame:
    """(by, session_start, session_end, n): runs of rows with gaps below gap_s seconds."""
    w = Window.partitionBy(*by).orderBy(at)
    sec = F.unix_micros(F.col(at).cast("timestamp"))
    new = (sec - F.lag(sec).over(w) >= gap_s * 1_000_000).cast("int")
    tagged = df.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return tagged.groupBy(*by, "_s").agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count("*").alias("n")).drop("_s")
