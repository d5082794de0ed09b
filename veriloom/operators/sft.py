"""Supervised fine-tuning data: rendering, tokens, masks, padded batches and the training metric."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions import arrays as A
from veriloom.functions import text as X

IDS = T.ArrayType(T.IntegerType())


def word_ids(text: Column) -> Column:
    """Stub tokens for tests: an id below 2^24 by md5 of each word between blanks; null and empty texts have none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int"))


def tokenizer_udf(load: Callable[[], object]) -> Callable[[Column], Column]:
    """Token ids by an encoder with encode_ordinary; load() makes one, once a worker."""

    @F.pandas_udf(IDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load()
        for b in batches:
            yield b.map(lambda t: enc.encode_ordinary(t) if isinstance(t, str) else [])

    return run


def render(df: DataFrame, question: str, cot: str, response: str) -> DataFrame:
    """df with prompt (user turn and assistant header) and full (with the answer). Rows with a null text have nulls."""
    q, answer = F.col(question), X.sft_target(F.col(cot), F.col(response))
    return df.withColumn("prompt", X.chat([("user", q)], ask=True)).withColumn("full", X.chat([("user", q), ("assistant", answer)]))


def masked_tokens(df: DataFrame, most: int, encode: Callable[[Column], Column] = word_ids) -> DataFrame:
    """df (prompt, full) with input_ids and labels: labels of the prompt's places are ignored, the last `most` are kept."""
    df = df.withColumn("_ids", encode(F.col("full"))).withColumn("_n", F.size(encode(F.col("prompt"))))
    df = df.withColumn("_labels", A.mask_prompt(F.col("_ids"), F.col("_n")))
    return df.withColumn("input_ids", A.keep_last(F.col("_ids"), most)).withColumn("labels", A.keep_last(F.col("_labels"), most)).drop("_ids", "_n", "_labels")


def padded(df: DataFrame, batch: str, most: int, pad: int, left: bool = False, columns: dict[str, int] | None = None) -> DataFrame:
    """df with its token arrays as long as the longest of their batch, `most` at the longest.

    columns names the arrays with their fill; by default input_ids with pad and labels with the ignored label. The
    rows are shuffled once, to their batches; those are of a fixed number of rows.
    """
    columns = columns or {"input_ids": pad, "labels": A.IGNORED}
    lead = next(iter(columns))
    out = df.withColumn("_width", F.least(F.max(F.size(lead)).over(Window.partitionBy(batch)), F.lit(most)))
    for c, fill in columns.items():
        out = out.withColumn(c, A.pad_left(F.col(c), F.col("_width"), fill) if left else A.pad_right(F.col(c), F.col("_width"), fill))
    return out.drop("_width")


def token_hits(predicted: Column, labels: Column) -> tuple[Column, Column]:
    """(right, counted) of a sequence: predictions against the labels one place further, ignored labels left out."""
    shifted = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(predicted, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))).alias("p"), shifted.alias("l"))
    counted = F.filter(pairs, lambda x: x["l"] != A.IGNORED)
    return F.size(F.filter(counted, lambda x: x["p"] == x["l"])), F.size(counted)


def metric(steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, accuracy, loss) of rows (right, total, loss), one for each rank and step; every rank has as many steps."""
    return steps.groupBy(*by).agg(F.try_divide(F.sum("right"), F.sum("total")).alias("accuracy"), F.avg("loss").alias("loss"))


# Parts of names of parameters that are not decayed.
def decay_groups(names: DataFrame, column: str, exempt: tuple[str, ...] = ("bias", "LayerNorm.weight")) -> DataFrame:
    """names with column decays: false where the name contains one of the exempt parts."""
    hit = F.lit(False)
    for part in exempt:
        hit = hit | F.contains(F.col(column), F.lit(part))
    return names.withColumn("decays", ~hit)
