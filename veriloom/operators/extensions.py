"""Operators that were only planned for the pipeline: checks, process rewards, verifier metrics, sampling of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """df with a fixed split by hash of the key: shares in thousandths, in the order given; the last takes the rest."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000))
    out, at = F.lit(list(shares)[-1]), 0
    edges = []
    for name, s in shares.items():
        at += round(1000 * s)
        edges.append((name, at))
    for name, edge in reversed(edges[:-1]):
        out = F.when(h < edge, name).otherwise(out)
    return df.withColumn("split", out)


def candidates(df: DataFrame, n: int = 4) -> DataFrame:
    """Each row n times, with column candidate from 0."""
    return df.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def repetition(text: Column, n: int = 4) -> Column:
    """Share of the word n-grams that occurred before in the text; 0 for shorter texts."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    grams = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return F.coalesce(1 - F.size(F.array_distinct(grams)) / F.size(grams), F.lit(0.0))


def abnormal_length(df: DataFrame, text: str, by: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with abnormal: whether the length lies outside the group's quantiles (approximate, one aggregate)."""
    q = df.groupBy(*by).agg(F.percentile_approx(F.length(text), [low, high], 10_000).alias("_q"))
    return df.join(q, by, "left").withColumn("abnormal", (F.length(text) < F.col("_q")[0]) | (F.length(text) > F.col("_q")[1])).drop("_q")


def first_wrong(labels: Column) -> Column:
    """0-based place of the first step labelled 0; null if there is none."""
    p = F.array_position(labels, 0)
    return F.when(p > 0, p - 1).cast("int")


def process_reward(scores: Column) -> Column:
    """Half the least and half the mean of the step scores."""
    return 0.5 * F.array_min(scores) + 0.5 * F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), F.size(scores))


def composite_reward(correct: Column, process: Column, form: Column, brevity: Column, penalties: Column) -> Column:
    """Weighted sum .45, .25, .20, .10 less penalties."""
    return 0.45 * correct + 0.25 * process + 0.20 * form + 0.10 * brevity - penalties


def binary_metrics(df: DataFrame, label: str, score: str, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by, n, accuracy, f1, auroc) of scores against 0/1 labels; auroc by rank sums with mid-ranks, null for one class.

    Equal scores are counted together before anything is ordered, so the window runs over distinct scores.
    """
    per = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    below = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_less", F.coalesce(F.sum("_q").over(below), F.lit(0)))
    yes = F.col("_s") >= threshold
    s = lambda c: F.sum(F.when(yes, F.col(c)).otherwise(0))
    out = per.groupBy(*by).agg(F.sum(F.col("_p") + F.col("_q")).alias("n"), F.sum("_p").alias("_P"), F.sum("_q").alias("_Q"), s("_p").alias("_tp"), s("_q").alias("_fp"), F.sum(F.col("_p") * (F.col("_less") + F.col("_q") / 2)).alias("_u"))
    return out.select(
        *by, "n", F.try_divide(F.col("_tp") + F.col("_Q") - F.col("_fp"), F.col("n")).alias("accuracy"), F.try_divide(2 * F.col("_tp"), F.col("_tp") + F.col("_fp") + F.col("_P")).alias("f1"), F.try_divide(F.col("_u"), F.col("_P") * F.col("_Q")).alias("auroc")
    )


def agreement(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n, agree, rate_a, rate_b) of two verdicts; rows with a null verdict are left out."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agree"), F.avg(F.col(a).cast("double")).alias("rate_a"), F.avg(F.col(b).cast("double")).alias("rate_b"))


def informative_groups(df: DataFrame, group: str, reward: str, least_std: float = 0.0) -> DataFrame:
    """(group, n, mean, std) of the groups whose rewards are neither all alike nor below the least deviation."""
    g = df.groupBy(group).agg(F.count(reward).alias("n"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"), F.min(reward).alias("_lo"), F.max(reward).alias("_hi"))
    return g.filter((F.col("_lo") < F.col("_hi")) & (F.col("std") > least_std)).drop("_lo", "_hi")


def adaptive_coefficient(kls: Column, start: float, target: float, horizon: float, clip_error: float = 0.2) -> Column:
    """Coefficient after a sequence of measured divergences, adapted step by step."""
    err = lambda k: F.greatest(F.lit(-clip_error), F.least(F.lit(clip_error), k / target - 1))
    return F.aggregate(kls, F.lit(float(start)), lambda c, k: c * (1 + err(k) / horizon))


def asymmetric_clip(ratio: Column, low: float = 0.2, high: float = 0.28) -> Column:
    """A ratio within 1 - low and 1 + high."""
    return F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))


def overlong_penalty(n: Column, soft: int, hard: int) -> Column:
    """0 up to soft tokens, then down in a line to -1 at hard and beyond."""
    return -F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n - soft) / float(hard - soft)))


def compared(df: DataFrame, value: str, by: str, stage: str, stages: list[str]) -> DataFrame:
    """(by, a column for each of the stages): the mean value by stage, side by side."""
    return df.groupBy(by).pivot(stage, stages).agg(F.avg(value))


def over_seeds(df: DataFrame, value: str, by: list[str], least: int = 3) -> DataFrame:
    """(by, runs, mean, std) over seeds; the deviation is null below `least` runs."""
    out = df.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_std"))
    return out.withColumn("std", F.when(F.col("runs") >= least, F.col("_std"))).drop("_std")
