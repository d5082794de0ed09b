"""Evaluation: items to prompts, completions, answers and scores; one narrow stage and one aggregate by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.operators import answers
from veriloom.plans.prompts import prompt_set
from veriloom.session import materialise
from veriloom.sources.completion import Completer, checked, complete


def prompts(items: DataFrame, strict: bool = True, chat: bool = False) -> DataFrame:
    """items with option_str and input_str."""
    out = items.withColumn("option_str", X.options_text(F.col("options")))
    text = X.fill(prompt_set()["strict" if strict else "free"], question=F.col("question"), options=F.col("option_str"))
    return out.withColumn("input_str", X.chat([("user", text)], ask=True) if chat else text)


def answered(items: DataFrame, completer: Completer, strict: bool = True, chat: bool = False, batch: int = 1024, max_chars: int = 0, most_failed: float = 0.5) -> DataFrame:
    """All items with input_str, output (as said, null where the call failed) and error. Raises where too many fail."""
    asked = prompts(items, strict, chat).withColumn("input_str", X.keep_tail(F.col("input_str"), max_chars))
    return checked(materialise(complete(asked, "input_str", completer, batch, "output"), "predictions"), most_failed)


def predict(items: DataFrame, completer: Completer, strict: bool = True, chat: bool = False, batch: int = 1024, max_chars: int = 0, most_failed: float = 0.5) -> DataFrame:
    """items with output: postprocessed completions; rows with an empty one are left out, as are failed ones (see answered)."""
    said = answered(items, completer, strict, chat, batch, max_chars, most_failed).drop("error")
    return said.withColumn("output", X.postprocess(F.col("output"))).filter(F.length("output") > 0)


def evaluate(items: DataFrame, completer: Completer, strict: bool = True, ignore_miss: bool = False) -> DataFrame:
    """Scores by source of a completer's answers."""
    return answers.score(answers.extract(predict(items, completer, strict)), ignore_miss=ignore_miss)
