"""Verify-and-retry search over open questions, as rounds over DataFrames.

The bound on rounds is static, so the driver unrolls them; records still pending are filtered between the
rounds, and each round's calls are written once, with what was read from the answers. A round's work follows the
pending records, which are spread anew over the tasks. Verdicts, steps and provenance go with the record.

The tables of the calls are also the log of the search: all queries and answers, those of abandoned attempts, of
failed calls and of answers that do not validate included. Nothing is kept twice for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import jsonx
from veriloom.functions import text as X
from veriloom.operators.relational import choose
from veriloom.plans.prompts import STRATEGIES, prompt_set
from veriloom.session import materialise
from veriloom.sources.completion import Completer, checked, complete


@dataclass(frozen=True)
class SearchConfig:
    """attempts x depth bounds the rounds; efficient asks with the answer in hand at last. most_failed: share of failed calls of a stage that ends the search."""

    attempts: int = 1
    depth: int = 2
    efficient: bool = True
    language: str = "same"
    seed: int = 0
    most_failed: float = 0.5


@dataclass
class _Calls:
    """Sends the calls and keeps their log."""

    completer: Completer
    most_failed: float
    log: list[DataFrame] = field(default_factory=list)

    def __call__(self, df: DataFrame, template: Column, kind: str, attempt: int, round_: int, read) -> DataFrame:
        """The rows whose call came through, with said and, from read(said), got: a struct with ok. calls counts the record's calls."""
        asked = df.withColumn("query", template).withColumn("calls", F.col("calls") + 1)
        done = complete(asked, "query", self.completer, out="said").withColumn("got", read(F.col("said")))
        done = checked(materialise(done, kind), self.most_failed)
        steps, verdict = (F.col("got.steps") if kind in ("init", "rethink", "label") else F.lit(None).cast(jsonx.STEPS["steps"].dataType)), (F.col("got.verdict") if kind == "verify" else F.lit(None).cast("boolean"))
        strategy = F.col("strategy") if "strategy" in df.columns else F.lit(None).cast("string")
        event = [F.lit(attempt).alias("attempt"), F.lit(round_).alias("round"), F.lit(kind).alias("kind"), strategy.alias("strategy"), "query", F.col("said").alias("response"), steps.alias("steps"), verdict.alias("verdict"), F.coalesce("got.ok", F.lit(False)).alias("valid"), "error"]
        self.log.append(done.select("process_id", *event))
        return done.drop("query")

    def events(self) -> DataFrame:
        out = self.log[0]
        for more in self.log[1:]:
            out = out.unionByName(more)
        return out


def _verdict(said: Column) -> Column:
    return F.struct(said.isNotNull().alias("ok"), F.coalesce(X.verdict(said), F.lit(False)).alias("verdict"))


def _any(said: Column) -> Column:
    return F.struct(said.isNotNull().alias("ok"))


def search(df: DataFrame, completer: Completer, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Records (process_id, open_question, gold_answer) with steps, verify, response_type, archived, calls, complex_cot, response; see search_with_events."""
    return search_with_events(df, completer, config)[0]


def search_with_events(df: DataFrame, completer: Completer, config: SearchConfig = SearchConfig()) -> tuple[DataFrame, DataFrame]:
    """(records, events) of a search.

    Records without a question take no part; one with a call that failed, or an answer that does not validate, drops out.
    Unsolved records, and those whose rewriting does not validate, have no complex_cot (see merged). archived counts
    the earlier attempts that were given up.

    Events (process_id, attempt, round, kind, strategy, query, response, steps, verdict, valid, error) are all calls, also of
    records that dropped out and of attempts given up; kind is init, verify, rethink, label, rewrite or final. Where more
    calls of a stage fail than config.most_failed (and more than a few), the search raises.
    """
    prompts = prompt_set(config.language)
    call = _Calls(completer, config.most_failed)
    q, is_true = F.col("open_question"), F.element_at("verify", -1)

    def judged(state: DataFrame, attempt: int, round_: int) -> DataFrame:
        """state with the verdict on its conclusion appended to verify."""
        ask = X.fill(prompts["verify"], conclusion=F.coalesce(X.final_conclusion(F.col("steps")), F.lit("")), answer=F.coalesce("gold_answer", F.lit("")))
        out = call(state, ask, "verify", attempt, round_, _verdict).filter("got.ok")
        return out.withColumn("verify", F.array_append("verify", F.col("got.verdict"))).drop("said", "got", "error")

    def told(state: DataFrame, ask: Column, kind: str, attempt: int, round_: int) -> DataFrame:
        """state with the steps of a valid answer in column more."""
        return call(state, ask, kind, attempt, round_, jsonx.parse_steps).filter("got.ok").withColumn("more", F.col("got.steps")).drop("said", "got", "error")

    state = df.select("process_id", "open_question", "gold_answer").filter(q.isNotNull())
    state = state.withColumns({"calls": F.lit(0), "verify": F.array().cast("array<boolean>"), "archived": F.lit(0)})
    state = told(state, X.fill(prompts["init"], question=q), "init", 0, 0)
    state = state.withColumn("steps", F.col("more")).withColumn("response_type", F.array(F.lit("Init_CoT"))).drop("more")
    state = judged(state, 0, 0)
    state = state.withColumns({"first_steps": F.col("steps"), "first_verify": F.col("verify")})
    solved: list[DataFrame] = []
    for a in range(config.attempts):
        if a:
            state = state.withColumns({"steps": F.col("first_steps"), "verify": F.col("first_verify"), "response_type": F.array(F.lit("Init_CoT")), "archived": F.col("archived") + 1})
        for r in range(config.depth):
            solved.append(state.filter(is_true))
            state = state.filter(~is_true).repartition("process_id")
            if state.isEmpty():
                break
            how = choose(STRATEGIES, F.col("process_id").cast("string"), F.lit(str(a)), F.lit(str(r)), F.lit(str(config.seed)), skip_first=F.lit(r == 0))
            state = state.withColumn("strategy", how)
            ask = X.fill(prompts[f"search:{STRATEGIES[-1]}"], question=q, steps=X.steps_json(F.col("steps")))
            for s in STRATEGIES[:-1]:
                ask = F.when(F.col("strategy") == s, X.fill(prompts[f"search:{s}"], question=q, steps=X.steps_json(F.col("steps")))).otherwise(ask)
            state = told(state, ask, "rethink", a, r)
            state = state.withColumn("steps", X.continued(F.col("steps"), F.col("more"))).withColumn("response_type", F.array_append("response_type", F.concat(F.lit("Re_CoT_"), "strategy"))).drop("more", "strategy")
            state = judged(state, a, r + 1)
        solved.append(state.filter(is_true))
        state = state.filter(~is_true)
    last = config.attempts - 1
    if config.efficient and not state.isEmpty():
        ask = X.fill(prompts["label"], question=q, answer=F.coalesce("gold_answer", F.lit("")), steps=X.steps_json(F.col("steps")))
        out = told(state, ask, "label", last, config.depth)
        solved.append(out.withColumn("steps", X.continued(F.col("steps"), F.col("more"))).withColumn("response_type", F.array_append("response_type", F.lit("Label_CoT"))).withColumn("verify", F.array_append("verify", F.lit(True))).drop("more"))
        state = state.limit(0)
    done = solved[0]
    for more in solved[1:]:
        done = done.unionByName(more)
    done = call(done, X.fill(prompts["rewrite"], text=X.stream_of_search(F.col("steps")), question=q), "rewrite", last, config.depth, jsonx.parse_rewrite)
    good = done.filter("got.ok").withColumn("complex_cot", F.col("got.text")).drop("said", "got", "error")
    good = call(good, X.fill(prompts["final"], text=F.col("complex_cot"), question=q), "final", last, config.depth, _any).withColumnRenamed("said", "response").drop("got", "error")
    untold = done.filter("not coalesce(got.ok, false)").drop("said", "got", "error").unionByName(state)
    records = good.unionByName(untold, allowMissingColumns=True).drop("first_steps", "first_verify").withColumn("question", q)
    return records, call.events()


def merged(searched: DataFrame) -> DataFrame:
    """Records that came through: with a rewritten reasoning and a response."""
    return searched.filter(F.col("complex_cot").isNotNull() & F.col("response").isNotNull())
