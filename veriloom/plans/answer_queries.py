"""Queries on predictions: prompts, extraction, scores; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.operators import answers, extensions, relational
from veriloom.plans import evaluate
from veriloom.sources.completion import StubCompleter
from veriloom.sources.tables import latest_delivery, load

PRED = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY arrived_at DESC) AS rn FROM prediction) WHERE rn = 1)"
SECTION = "CASE WHEN instr(output, '## Final Response' || chr(10) || chr(10)) > 0 THEN string_split(output, '## Final Response' || chr(10) || chr(10))[-1] ELSE output END"


def _predictions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_delivery(load(spark, d, "prediction", "prediction_id", "arrived_at", *columns), "prediction_id")


def _extracted(spark: SparkSession, d: str, fuzzy: bool = True) -> DataFrame:
    df = _predictions(spark, d, "model", "source", "options", "answer_idx", "output").filter(F.length("output") > 0)
    return answers.extract(df, fuzzy=fuzzy)


def options_prompt(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "eval_item", "item_id", "question", "options")
    return items.select("item_id", X.options_text(F.col("options")).alias("option_str"), X.question_block(F.col("question"), F.col("options")).alias("block"))


def eval_prompts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.prompts(load(spark, d, "eval_item"), strict=True).select("item_id", "input_str")


def postprocessed(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d, "output").select("prediction_id", X.postprocess(F.col("output")).alias("output")).filter(F.length("output") > 0)


def answer_strict(spark: SparkSession, d: str) -> DataFrame:
    df = _predictions(spark, d, "output").withColumn("m", answers.strict_letters(X.last_section(F.col("output")))).filter(F.size("m") > 0)
    return df.select("prediction_id", F.get("m", F.lit(0)).alias("ans_first"), F.try_element_at("m", F.lit(-1)).alias("ans_last"), F.size("m").cast("long").alias("n"))


def answer_free(spark: SparkSession, d: str) -> DataFrame:
    df = _predictions(spark, d, "output", "options").withColumn("m", answers.free_letters(X.last_section(F.col("output")), F.size("options"))).filter(F.size("m") > 0)
    return df.select("prediction_id", F.get("m", F.lit(0)).alias("ans_first"), F.try_element_at("m", F.lit(-1)).alias("ans_last"), F.size("m").cast("long").alias("n"))


def answer_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d, fuzzy=False).select("prediction_id", "ans_first", "ans_last", F.col("ans_type").cast("long").alias("ans_type"))


def answer_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).filter("ans_type = 3").select("prediction_id", "ans_first")


def score_by_source(spark: SparkSession, d: str) -> DataFrame:
    return answers.score(_extracted(spark, d))


def score_strict(spark: SparkSession, d: str) -> DataFrame:
    s = answers.score(_extracted(spark, d, fuzzy=False), ignore_miss=True)
    return s.select("source", F.round("score", 6).alias("score"), "head_hits", "total", "tail_hits")


def correct_wrong(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.mark(_extracted(spark, d, fuzzy=False)).filter("ans_type < 3")
    return rows.groupBy("model", "head_hit").agg(F.count("*").alias("n"))


def evaluate_stub(spark: SparkSession, d: str) -> DataFrame:
    stub = StubCompleter(default=("The answer is A.", " The answer is B.</s>", "(C)", ""))
    return evaluate.evaluate(load(spark, d, "eval_item"), stub)


def gold_in_output(spark: SparkSession, d: str) -> DataFrame:
    df = _predictions(spark, d, "output", "options", "answer_idx")
    gold = F.transform(F.filter("options", lambda o: o["label"] == F.col("answer_idx")), lambda o: F.lower(o["text"]))
    return df.filter(F.col("output").isNotNull()).select("prediction_id", X.contains_answer(F.col("output"), gold).alias("hit"))


def verifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.mark(_extracted(spark, d, fuzzy=False)).filter("ans_type < 3")
    rows = rows.select("model", F.col("head_hit").cast("int").alias("label"), (relational.md5_number(F.col("prediction_id").cast("string")) % 100 / 100).alias("s"))
    out = extensions.binary_metrics(rows, "label", "s", ["model"])
    return out.select("model", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "auroc")])


def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.mark(_extracted(spark, d, fuzzy=False)).filter("ans_type < 3")
    out = extensions.agreement(rows, "head_hit", "tail_hit", ["model"])
    return out.select("model", "n", *[F.round(c, 6).alias(c) for c in ("agree", "rate_a", "rate_b")])


def informative_items(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.mark(_extracted(spark, d, fuzzy=False)).filter("ans_type < 3")
    rows = load(spark, d, "prediction", "prediction_id", "item_id").distinct().join(rows, "prediction_id").withColumn("r", F.col("head_hit").cast("double"))
    return extensions.informative_groups(rows, "item_id", "r").select("item_id", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def output_lengths(spark: SparkSession, d: str) -> DataFrame:
    df = _predictions(spark, d, "model", "source", "output").filter(F.length("output") > 0)
    per = df.groupBy("model", "source").agg(F.avg(F.length("output")).alias("chars"), F.avg(X.has_answer_format(F.col("output")).cast("double")).alias("formatted"))
    out = extensions.over_seeds(per, "chars", ["model"])
    return out.select("model", "runs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


QUERIES = {f.__name__: f for f in (options_prompt, eval_prompts, postprocessed, answer_strict, answer_free, answer_cascade, answer_fuzzy, score_by_source, score_strict, correct_wrong, evaluate_stub, gold_in_output, verifier_metrics, model_agreement, informative_items, output_lengths)}

_OPTS = "array_to_string(list_transform(options, lambda o: o.label || '. ' || o.text), chr(10))"
_HAN = r"一-鿿"
_LEFT = rf"(?:[{_HAN}]|is |[^\p{{L}}\p{{N}}_]|^|#)"


def _free_sql(n: int) -> str:
    rest = "BCDEFGHIJKLMN"[: n - 1]
    right = lambda extra: rf"(?:[^\p{{L}}\p{{N}}_{extra}]|[{_HAN}]|$)"
    alt = rf"A{right(' ')}" + (rf"|[{rest}]{right('')}" if rest else "")
    return rf"list_transform(regexp_extract_all(sec, '(?s){_LEFT}({alt})', 1), lambda m: left(m, 1))"


_FREE = "CASE len(options) " + " ".join(f"WHEN {n} THEN {_free_sql(n)}" for n in range(1, 8)) + " END"
_STRICT = r"regexp_extract_all(sec, '(?s)answer is\s*?([A-N])', 1)"
_CASC = f"""{PRED}, s AS (SELECT *, {SECTION} AS sec FROM p WHERE length(output) > 0),
m AS (SELECT *, CASE WHEN len({_STRICT}) > 0 THEN {_STRICT} WHEN len({_FREE}) > 0 THEN {_FREE} END AS letters,
  list_filter(list_transform(options, lambda o, i: struct_pack(label := o.label, i := i,
    f := instr(lower(sec), lower(o.text)),
    b := length(sec) - length(o.text) - instr(reverse(lower(sec)), reverse(lower(o.text))) + 2)), lambda x: x.f > 0) AS seen FROM s),
c AS (SELECT * EXCLUDE (letters, seen),
  CASE WHEN letters IS NOT NULL THEN letters[1] WHEN len(seen) > 0 THEN list_sort(list_transform(seen, lambda x: struct_pack(a := -x.f, i := x.i, l := x.label)))[1].l END AS ans_first,
  CASE WHEN letters IS NOT NULL THEN letters[-1] WHEN len(seen) > 0 THEN list_sort(list_transform(seen, lambda x: struct_pack(a := -x.b, i := x.i, l := x.label)))[1].l END AS ans_last,
  CASE WHEN letters IS NOT NULL THEN 1 WHEN len(seen) > 0 THEN 2 ELSE 3 END AS ans_type FROM m),
h AS (SELECT *, coalesce(lower(ans_first) = lower(answer_idx), false) AS head_hit, coalesce(lower(ans_last) = lower(answer_idx), false) AS tail_hit FROM c)"""

ORACLE = {
    "options_prompt": f"SELECT item_id, {_OPTS} AS option_str, question || chr(10) || {_OPTS} AS block FROM eval_item",
    "eval_prompts": f"SELECT item_id, 'Choose one option and end with: The answer is X.' || chr(10) || question || chr(10) || {_OPTS} AS input_str FROM eval_item",
    "postprocessed": f"WITH {PRED}, q AS (SELECT prediction_id, regexp_replace(replace(output, '</s>', ''), '^ ', '') AS output FROM p) SELECT * FROM q WHERE length(output) > 0",
    "answer_strict": f"WITH {PRED}, s AS (SELECT prediction_id, {SECTION} AS sec FROM p), m AS (SELECT prediction_id, {_STRICT} AS m FROM s) SELECT prediction_id, m[1] AS ans_first, m[-1] AS ans_last, len(m)::BIGINT AS n FROM m WHERE len(m) > 0",
    "answer_free": f"WITH {PRED}, s AS (SELECT prediction_id, options, {SECTION} AS sec FROM p), m AS (SELECT prediction_id, {_FREE} AS m FROM s) SELECT prediction_id, m[1] AS ans_first, m[-1] AS ans_last, len(m)::BIGINT AS n FROM m WHERE len(m) > 0",
    "answer_cascade": f"WITH {_CASC} SELECT prediction_id, ans_first, ans_last, ans_type::BIGINT AS ans_type FROM c",
    "score_strict": f"""WITH {_CASC}, a AS (SELECT coalesce(source, 'unknown') AS source, count(*) FILTER (ans_type = 1 AND head_hit) AS head_hits, count(*) FILTER (ans_type = 1) AS total,
count(*) FILTER (ans_type = 1 AND tail_hit) AS tail_hits FROM h GROUP BY 1) SELECT source, round(greatest(head_hits, tail_hits)::DOUBLE / nullif(total, 0), 6) AS score, head_hits, total, tail_hits FROM a""",
    "correct_wrong": f"WITH {_CASC} SELECT model, head_hit, count(*) AS n FROM h WHERE ans_type < 3 GROUP BY ALL",
    "evaluate_stub": f"""WITH q AS (SELECT source, answer_idx, ('0x' || substr(md5('Choose one option and end with: The answer is X.' || chr(10) || question || chr(10) || {_OPTS}), 1, 8))::BIGINT % 4 AS k FROM eval_item),
a AS (SELECT coalesce(source, 'unknown') AS source, count(*) FILTER (answer_idx = ['A', 'B', 'C'][k + 1]) AS hits, count(*) AS total FROM q WHERE k < 3 GROUP BY 1) SELECT source, hits / total AS score, hits AS head_hits, total, hits AS tail_hits FROM a""",
    "gold_in_output": rf"""WITH {PRED}, g AS (SELECT prediction_id, lower(output) AS o, list_transform(list_filter(options, lambda x: x.label = answer_idx), lambda x: lower(x.text)) AS gold FROM p WHERE output IS NOT NULL)
SELECT prediction_id, coalesce(len(list_filter(gold, lambda t: regexp_matches(o, '(?s)([^\p{{L}}\p{{N}}_]|^)' || regexp_escape(t) || '([^\p{{L}}\p{{N}}_]|$)'))) > 0, false) AS hit FROM g""",
    "verifier_metrics": f"""WITH {_CASC}, x AS (SELECT model, head_hit::INT AS l, (('0x' || substr(md5(prediction_id::VARCHAR), 1, 8))::BIGINT % 100)::DOUBLE / 100 AS s FROM h WHERE ans_type < 3),
r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0 AS rk FROM x)
SELECT model, count(*) AS n, round(avg(((s >= 0.5)::INT = l)::INT), 6) AS accuracy, round(2.0 * sum(l * (s >= 0.5)::INT) / (2 * sum(l * (s >= 0.5)::INT) + sum((1 - l) * (s >= 0.5)::INT) + sum(l * (s < 0.5)::INT)), 6) AS f1,
round((sum(rk * l) - sum(l) * (sum(l) + 1) / 2.0) / (sum(l) * sum(1 - l)), 6) AS auroc FROM r GROUP BY model""",
    "model_agreement": f"WITH {_CASC} SELECT model, count(*) AS n, round(avg((head_hit = tail_hit)::INT), 6) AS agree, round(avg(head_hit::INT), 6) AS rate_a, round(avg(tail_hit::INT), 6) AS rate_b FROM h WHERE ans_type < 3 GROUP BY model",
    "informative_items": f"WITH {_CASC} SELECT item_id, count(*) AS n, round(avg(head_hit::INT), 6) AS mean, round(stddev_pop(head_hit::INT), 6) AS std FROM h WHERE ans_type < 3 GROUP BY item_id HAVING min(head_hit::INT) < max(head_hit::INT)",
    "output_lengths": f"WITH {PRED}, q AS (SELECT model, source, avg(length(output)) AS c FROM p WHERE length(output) > 0 GROUP BY ALL) SELECT model, count(*) AS runs, round(avg(c), 6) AS mean, CASE WHEN count(*) >= 3 THEN round(stddev_samp(c), 6) END AS std FROM q GROUP BY model",
}
