"""Answers of multiple-choice predictions: extraction and accuracy by source.

Extraction is a cascade on the last final section: the strict wording, a free-standing option letter, the text
of an option, and at last the option most similar to the whole answer. All but the last step are built-in
expressions; the similarity is a pandas UDF that is given null for all rows that were settled before.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.text import FREE_LEFT, FREE_RIGHT, LETTERS, STRICT, last_section


def strict_letters(text: Column) -> Column:
    """All letters behind `answer is`; any of A to N, whatever follows."""
    return F.regexp_extract_all(text, F.lit(STRICT), F.lit(2))


def free_letters(text: Column, n_options: Column) -> Column:
    """All letters of the options that stand alone; an A before a blank is an article."""
    known = F.substring(F.lit(LETTERS), F.lit(1), F.greatest(n_options, F.lit(1)))
    return F.regexp_extract_all(text, F.concat(F.lit(rf"(?sdU){FREE_LEFT}(?![aA] )(["), known, F.lit(rf"]){FREE_RIGHT}")), F.lit(2))


def _placed(text: Column, options: Column, last: bool) -> Column:
    """Label of the option whose text has the greatest place in text: its last place, or its first."""
    t = F.lower(text)

    def place(o: Column) -> Column:
        x = F.lower(o["text"])
        first = F.call_function("locate", x, t)
        if not last:
            return first - 1
        back = F.call_function("locate", F.reverse(x), F.reverse(t))
        return F.length(t) - F.length(x) - back + 1

    seen = F.filter(options, lambda o: F.contains(t, F.lower(o["text"])))
    return F.array_max(F.transform(seen, lambda o, i: F.struct(place(o).alias("at"), (-i).alias("i"), o["label"].alias("label"))))["label"]


@F.pandas_udf(T.StringType())
def most_similar(text: pd.Series, options: pd.Series) -> pd.Series:
    """Label of the option most similar to the text (Ratcliff-Obershelp); of equals, the last. Null for a null text."""

    def one(t: object, opts: object) -> str | None:
        if not isinstance(t, str) or opts is None or not len(opts):
            return None
        t = t.lower()
        best, label = 0.0, None
        for o in opts:
            r = difflib.SequenceMatcher(None, (o["text"] or "").lower(), t).ratio()
            if r >= best:
                best, label = r, o["label"]
        return label

    return pd.Series([one(t, o) for t, o in zip(text, options)], dtype=object)


def extract(df: DataFrame, output: str = "output", options: str = "options", fuzzy: bool = True, corrected: bool = False) -> DataFrame:
    """df with ans_first, ans_last and ans_type: 1 a letter, 2 an option's text, 3 the most similar option.

    Type 2 takes as first the option whose first occurrence is the latest; with corrected, the earliest. Without
    fuzzy, what type 3 would settle stays null. A null output stays null; without options there is no type 2 or 3.
    """
    text, opts = F.col("_text"), F.col(options)
    df = df.withColumn("_text", last_section(F.col(output)))
    df = df.withColumn("_strict", strict_letters(text)).withColumn("_free", F.when(F.size("_strict") == 0, free_letters(text, F.size(opts))))
    letters = F.when(F.size("_strict") > 0, F.col("_strict")).when(F.size("_free") > 0, F.col("_free"))
    df = df.withColumn("_letters", letters)
    named_last = F.when(F.col("_letters").isNull(), _placed(text, opts, last=True))
    df = df.withColumn("_last", named_last)
    first = _placed(text, opts, last=False)
    if corrected:
        t = F.lower(text)
        first = F.array_min(F.transform(F.filter(opts, lambda o: F.contains(t, F.lower(o["text"]))), lambda o, i: F.struct(F.call_function("locate", F.lower(o["text"]), t).alias("at"), i.alias("i"), o["label"].alias("label"))))["label"]
    df = df.withColumn("_first", F.when(F.col("_last").isNotNull(), first))
    kind = F.when(F.col("_letters").isNotNull(), 1).when(F.col("_last").isNotNull(), 2).when(text.isNotNull(), 3)
    df = df.withColumn("ans_type", kind)
    fall = most_similar(F.when(F.col("ans_type") == 3, text), opts) if fuzzy else F.lit(None).cast("string")
    df = df.withColumn("_fuzzy", fall)
    df = df.withColumn("ans_first", F.coalesce(F.get("_letters", F.lit(0)), F.col("_first"), F.col("_fuzzy")))
    df = df.withColumn("ans_last", F.coalesce(F.try_element_at("_letters", F.lit(-1)), F.col("_last"), F.col("_fuzzy")))
    return df.drop("_text", "_strict", "_free", "_letters", "_last", "_first", "_fuzzy")


def mark(extracted: DataFrame, gold: str = "answer_idx") -> DataFrame:
    """extracted with head_hit and tail_hit: whether the first and the last answer are the gold one, in any case."""
    hit = lambda c: F.coalesce(F.lower(F.col(c)) == F.lower(F.col(gold)), F.lit(False))
    return extracted.withColumn("head_hit", hit("ans_first")).withColumn("tail_hit", hit("ans_last"))


def score(extracted: DataFrame, source: str = "source", ignore_miss: bool = False) -> DataFrame:
    """(source, score, head_hits, total, tail_hits): the better of head and tail accuracy.

    One partial and one final aggregate. A null source is `unknown`. With ignore_miss only type 1 counts; a source
    without such rows has a null score.
    """
    rows = mark(extracted).filter(F.col("ans_type").isNotNull())
    counted = F.col("ans_type") == 1 if ignore_miss else F.lit(True)
    out = rows.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("source")).agg(
        F.count_if(F.col("head_hit") & counted).alias("head_hits"), F.count_if(counted).alias("total"), F.count_if(F.col("tail_hit") & counted).alias("tail_hits")
    )
    return out.select("source", F.try_divide(F.greatest("head_hits", "tail_hits"), F.col("total")).alias("score"), "head_hits", "total", "tail_hits")
