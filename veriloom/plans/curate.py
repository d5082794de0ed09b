"""Curation: multiple-choice records to open questions, each model call materialised before it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions import jsonx
from veriloom.functions import text as X
from veriloom.operators.relational import limit_by_id, resume
from veriloom.plans.prompts import prompt_set
from veriloom.session import materialise
from veriloom.sources.completion import Completer, checked, complete


def curate(df: DataFrame, completer: Completer, done: DataFrame | None = None, filter_first: bool = True, limit: int = 0, attempts: int = 2, language: str = "same", most_failed: float = 0.5) -> DataFrame:
    """df (process_id, question, options, answer) with the queries, responses, open_question, gold_answer and error.

    Records that the filter turns away keep its response and have no question. A reformat answer that does not
    validate is asked for again, up to `attempts` times in all, for the failed records only. Records whose call
    failed have null responses and the error of the last one, and are not among the finished; see finished. Where more
    calls of a stage fail than most_failed (and more than a few), the curation raises.
    """

    def ask(df: DataFrame, name: str, read) -> DataFrame:
        asked = df.drop("error").withColumn(f"{name}_query", X.fill(prompts[name], question=block, answer=answer))
        out = complete(asked, f"{name}_query", completer, out=f"{name}_response")
        return checked(materialise(out.withColumn("_p", read(F.col(f"{name}_response"))), name), most_failed)

    prompts = prompt_set(language)
    df = limit_by_id(df, limit)
    if done is not None:
        df = resume(df, done)
    block, answer = X.question_block(F.col("question"), F.col("options")), F.col("answer")
    out: list[DataFrame] = []
    if filter_first:
        df = ask(df, "filter", lambda said: F.coalesce(X.passes(said), F.lit(False)))
        out.append(df.filter("not _p").drop("_p"))
        df = df.filter("_p").drop("_p")
    else:
        df = df.withColumn("filter_query", F.lit(None).cast("string")).withColumn("filter_response", F.lit(None).cast("string"))
    for k in range(attempts):
        # the prompt is the same each time; a completer that always says the same fails each time
        df = ask(df, "reformat", jsonx.parse_reformat)
        last = k == attempts - 1
        good = df if last else df.filter("_p.ok")
        out.append(good.withColumn("open_question", F.col("_p.question")).withColumn("gold_answer", F.col("_p.answer")).drop("_p"))
        if last:
            break
        df = df.filter("not _p.ok").drop("_p", "reformat_query", "reformat_response")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole


def finished(curated: DataFrame) -> DataFrame:
    """Records that need no further run: those with an open question or a filter response."""
    return curated.filter(F.col("open_question").isNotNull() | F.col("filter_response").isNotNull())
