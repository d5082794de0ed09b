"""Token sequences and numeric arrays as Column expressions: padding, masking, log-probabilities, rewards, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100  # label of a token that is not learned
INVALID_LOGPROB = 1.0  # what padded places hold


def total(a: Column) -> Column:
    """Sum of an array; 0 of an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def pad_right(ids: Column, n: Column | int, fill: int) -> Column:
    """The first n of ids, filled up behind."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.slice(ids, F.lit(1), n), F.array_repeat(F.lit(fill), F.greatest(n - F.size(ids), F.lit(0))))


def pad_left(ids: Column, n: Column | int, fill: int) -> Column:
    """The first n of ids, filled up in front."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.array_repeat(F.lit(fill), F.greatest(n - F.size(ids), F.lit(0))), F.slice(ids, F.lit(1), n))


def keep_last(ids: Column, n: int) -> Column:
    """The last n of ids."""
    return F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def mask_prompt(ids: Column, prompt_size: Column) -> Column:
    """Labels of ids: IGNORED for the prompt's places, the id itself behind."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_size, F.lit(IGNORED)).otherwise(x))


def first_index(a: Column, value: Column | int) -> Column:
    """0-based place of the first such element, or the size where there is none."""
    p = F.array_position(a, value)
    return F.when(p == 0, F.size(a)).otherwise(p - 1).cast("int")


def cut_at_stop(ids: Column, stop: Column | int, pad: int) -> Column:
    """Everything behind the first stop token replaced by pad; the stop token stays."""
    at = first_index(ids, stop)
    return F.transform(ids, lambda x, i: F.when(i > at, F.lit(pad)).otherwise(x))


def mask_after(a: Column, last: Column, fill: float) -> Column:
    """Elements behind place `last` replaced."""
    return F.transform(a, lambda x, i: F.when(i > last, F.lit(fill)).otherwise(x))


def scaled(logits: Column, temperature: float) -> Column:
    """Logits divided by the temperature."""
    return F.transform(logits, lambda x: x / F.lit(temperature + 1e-7))


def log_sum_exp(logits: Column) -> Column:
    """log of the sum of exponentials, safe for large values."""
    m = F.array_max(logits)
    return m + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - m)))


def log_prob(logits: Column, token: Column) -> Column:
    """Log-probability of a 0-based token; null outside."""
    return F.get(logits, token) - log_sum_exp(logits)


def entropy(logits: Column) -> Column:
    """Entropy of the distribution of logits."""
    m = log_sum_exp(logits)
    return m - F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - m) * x)


def argmax(logits: Column) -> Column:
    """0-based place of the (first) greatest."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def two_class(l0: Column, l1: Column) -> Column:
    """Probability of the second of two classes."""
    return 1 / (1 + F.exp(l0 - l1))


def rule_reward(well_formed: Column, p: Column) -> Column:
    """0 for a wrong format, 1 for a probability above 0.4, else 0.1."""
    return F.when(~well_formed, 0.0).when(p > 0.4, 1.0).otherwise(0.1)


def kl(logprobs: Column, ref: Column) -> Column:
    """Element-wise difference."""
    return F.zip_with(logprobs, ref, lambda a, b: a - b)


def rewards(kls: Column, score: Column, last: Column, kl_coef: float) -> Column:
    """-kl_coef x kl, with the score added behind the last token (or at it, where it is the last place)."""
    at = F.when(last + 1 < F.size(kls), last + 1).otherwise(last)
    return F.transform(kls, lambda x, i: x * F.lit(-kl_coef) + F.when(i == at, score).otherwise(F.lit(0.0)))


def gae(reward: Column, value: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages by a fold from the end; for sequences up to some hundred places (see operators.rl for longer)."""
    n = F.size(reward)
    delta = F.transform(reward, lambda r, i: r + F.lit(gamma) * F.coalesce(F.get(value, i + 1), F.lit(0.0)) - F.get(value, i))
    step = lambda acc, d: F.concat(F.array(d + F.lit(gamma * lam) * F.coalesce(F.get(acc, F.lit(0)), F.lit(0.0))), acc)
    return F.when(n > 0, F.aggregate(F.reverse(delta), F.array().cast("array<double>"), step)).otherwise(F.array().cast("array<double>"))


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    """x within lo and hi."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(lo), F.least(as_col(hi), x))
