"""Reinforcement-learning arithmetic over recorded rollouts: rewards, advantages, whitening, losses, metrics.

Sequences are arrays in one row, so everything inside a sequence is a narrow expression. What runs over all valid
places of a batch (whitening, masked means) is one pre-aggregated grouping by batch, joined back by batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions import arrays as A
from veriloom.session import materialise

_DOUBLES = T.ArrayType(T.DoubleType())


def advantage(reward: Column, value: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantages of sequences of any length: one backward pass over each Arrow batch, vectorised over its rows."""

    @F.pandas_udf(_DOUBLES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, v in batches:
            size = np.array([0 if x is None else len(x) for x in r])
            n = int(size.max(initial=0))
            rr, vv = np.zeros((len(r), n)), np.zeros((len(r), n + 1))
            for i, (x, y) in enumerate(zip(r, v)):
                if size[i]:
                    rr[i, : size[i]], vv[i, : size[i]] = x, y[: size[i]]
            out, acc = np.zeros((len(r), n)), np.zeros(len(r))
            for t in range(n - 1, -1, -1):
                acc = (rr[:, t] + gamma * vv[:, t + 1] - vv[:, t] + gamma * lam * acc) * (t < size)
                out[:, t] = acc
            yield pd.Series([None if x is None else out[i, : size[i]] for i, x in enumerate(r)], dtype=object)

    return run(reward, value)


def whiten(df: DataFrame, values: str, mask: Column, batch: str, shift_mean: bool = True) -> DataFrame:
    """df with `values` whitened over the places of a batch where mask(array of boolean) holds.

    (x - mean) / sqrt(var + 1e-8), with the unbiased variance; shift_mean=False keeps the mean. A batch of one
    place has no variance: its places become null. The frame is written before it is used for both.
    """
    df = materialise(df, "whiten")
    kept = df.select(batch, F.explode(F.arrays_zip(F.col(values).alias("x"), mask.alias("m"))).alias("p")).filter("p.m")
    stats = kept.groupBy(batch).agg(F.avg("p.x").alias("_mean"), F.var_samp("p.x").alias("_var"))
    scale = F.sqrt(F.col("_var") + 1e-8)
    back = F.lit(0.0) if shift_mean else F.col("_mean")
    return df.join(stats, batch, "left").withColumn(values, F.transform(values, lambda x: (x - F.col("_mean")) / scale + back)).drop("_mean", "_var")


def eos_count(responses: Column, eos: Column | int) -> Column:
    """Aggregate: number of stop tokens in all responses."""
    return F.sum(F.size(F.filter(responses, lambda x: x == eos)))


def missing_eos_penalty(score: Column, responses: Column, eos: Column | int, penalty: float | None) -> Column:
    """The score, less the penalty where the response has no stop token; None is no penalty."""
    return score if penalty is None else F.when(F.array_contains(responses, eos), score).otherwise(score - penalty)


class Scorer(Protocol):
    """Gives texts a logit each, as a reward model does. Instances are sent to the workers."""

    def logits(self, texts: list[str]) -> list[float]: ...


@dataclass(frozen=True)
class StubScorer:
    """Reproducible logits from -1 to 1 without a model, by md5 of the text."""

    def logits(self, texts: list[str]) -> list[float]:
        return [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 1000 / 500 - 1 for t in texts]


def scored(text: Column, scorer: Scorer, batch: int = 256) -> Column:
    """The logit of each text, in Arrow batches; null for a null text."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, texts.index, dtype="Float64")
        out[:] = pd.NA
        there = texts.index[texts.notna()]
        for lo in range(0, len(there), batch):
            part = there[lo : lo + batch]
            out.loc[part] = scorer.logits(list(texts.loc[part]))
        return out

    return run(text)


def throughput(n: Column, started: Column, ended: Column) -> Column:
    """Whole episodes a second from start to end; null where no time has passed."""
    return F.floor(F.try_divide(n, F.unix_timestamp(ended) - F.unix_timestamp(started))).cast("long")


def masked_mean(values: Column, mask: Column) -> Column:
    """Aggregate: mean of the values where mask holds; null without any."""
    return F.try_divide(F.sum(F.when(mask, values)), F.sum(mask.cast("int")))


def policy_terms(df: DataFrame, clip_range: float = 0.2) -> DataFrame:
    """Long rows (adv, new_logp, old_logp) with diff, ratio, pg1, pg2."""
    diff = F.col("new_logp") - F.col("old_logp")
    ratio = F.exp(diff)
    return df.withColumns({"diff": diff, "ratio": ratio, "pg1": -F.col("adv") * ratio, "pg2": -F.col("adv") * A.clip(ratio, 1.0 - clip_range, 1.0 + clip_range)})


def value_terms(df: DataFrame, clip_range: float = 0.2) -> DataFrame:
    """Long rows (vpred, old_value, ret) with vf1 and vf2."""
    clipped = A.clip(F.col("vpred"), F.col("old_value") - clip_range, F.col("old_value") + clip_range)
    sq = lambda x: (x - F.col("ret")) * (x - F.col("ret"))
    return df.withColumns({"vf1": sq(F.col("vpred")), "vf2": sq(clipped)})


def losses(rows: DataFrame, by: list[str], vf_coef: float = 0.1, clip_range: float = 0.2, value_clip: float = 0.2) -> DataFrame:
    """Losses of long rows (adv, new_logp, old_logp, vpred, old_value, ret, mask, mask_p1) by group, in one aggregate.

    Columns: pg_loss, pg_clipfrac, vf_loss, vf_clipfrac, approxkl (over all places), ratio, loss.
    """
    t = value_terms(policy_terms(rows, clip_range), value_clip)
    m, m1 = F.col("mask"), F.col("mask_p1")
    out = t.groupBy(*by).agg(
        masked_mean(F.greatest("pg1", "pg2"), m).alias("pg_loss"),
        masked_mean((F.col("pg2") > F.col("pg1")).cast("double"), m).alias("pg_clipfrac"),
        (0.5 * masked_mean(F.greatest("vf1", "vf2"), m1)).alias("vf_loss"),
        masked_mean((F.col("vf2") > F.col("vf1")).cast("double"), m1).alias("vf_clipfrac"),
        (0.5 * F.avg(F.col("diff") * F.col("diff"))).alias("approxkl"),
        F.avg("ratio").alias("ratio"),
    )
    return out.withColumn("loss", F.col("pg_loss") + vf_coef * F.col("vf_loss"))


def objective(df: DataFrame, kl: str, logprobs: str, score: str, by: list[str], kl_coef: float) -> DataFrame:
    """Means over sequences: kl, entropy, non_score_reward, rlhf_reward, scores."""
    return df.groupBy(*by).agg(
        F.avg(A.total(F.col(kl))).alias("kl"),
        F.avg(-A.total(F.col(logprobs))).alias("entropy"),
        F.avg(-kl_coef * A.total(F.col(kl))).alias("non_score_reward"),
        (F.avg(-kl_coef * A.total(F.col(kl))) + F.avg(score)).alias("rlhf_reward"),
        F.avg(score).alias("scores"),
    )


def mean_of_means(df: DataFrame, value: str, rank: str, by: list[str]) -> DataFrame:
    """Mean over ranks of each rank's mean, and the variance between the ranks: (by, mean, variance)."""
    per = df.groupBy(*by, rank).agg(F.avg(value).alias("_m"))
    return per.groupBy(*by).agg(F.avg("_m").alias("mean"), F.var_samp("_m").alias("variance"))


def trailing_mean(df: DataFrame, value: str, order: list[str], by: list[str], n: int = 50) -> DataFrame:
    """df with trailing_mean of the current and the n - 1 rows before, of those there are."""
    return df.withColumn("trailing_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)))


def batch_sizes(episodes: int, per_device: int, accumulation: int, minibatches: int, ranks: int) -> dict[str, int]:
    """Derived sizes of a run; raises where they do not divide."""
    local = per_device * accumulation * minibatches
    if local % minibatches:
        raise ValueError("the local batch must be a multiple of the minibatches")
    whole = local * ranks
    return {"micro": per_device * ranks, "local_batch": local, "batch": whole, "minibatch": whole // minibatches, "local_minibatch": local // minibatches, "updates": -(-episodes // whole)}


def interval(x: float, most: int) -> int:
    """A count, or below 1 a share of `most`, rounded up."""
    return int(np.ceil(most * x)) if x < 1 else int(x)


def cosine_schedule(spark, steps: int, warmup_rate: float, peak: float) -> DataFrame:
    """(step, lr): linear warm-up over int(rate x steps), then half a cosine down to zero."""
    warm = int(warmup_rate * steps)
    done = (F.col("id") - warm) / max(1, steps - warm)
    lr = F.when(F.col("id") < warm, peak * F.col("id") / max(1, warm)).otherwise(peak * F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.pi() * done))))
    return spark.range(steps).select(F.col("id").alias("step"), lr.alias("lr"))
