"""Queries on curated and searched records: resume, filters, validation, rendering, tokens; with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import arrays as A
from veriloom.functions import jsonx
from veriloom.functions import text as X
from veriloom.operators import extensions, relational, sft
from veriloom.plans.curate import curate, finished
from veriloom.plans.prompts import STRATEGIES, prompt_set
from veriloom.plans.search import SearchConfig, merged, search, search_with_events
from veriloom.sources.completion import StubCompleter
from veriloom.sources.tables import latest_delivery, load

_STEP = '{{"action": "{}", "content": "c{}"}}'
_GOOD = '{"CoT": [' + ", ".join(_STEP.format(a, i) for i, a in enumerate(("Inner Thinking", "Final Conclusion", "Verification"))) + "]}"
STUB = StubCompleter(
    rules=(
        ("Is this item hard", ("Pass", "Too Simple")),
        ("Turn the item", ('Here: {"Open-ended Verifiable Question": "q?", "Ground-True Answer": "a"}', '{"Open-ended Verifiable Question": 1}')),
        ("Does the conclusion", ("True", "False", "False")),
        ("Tell this", ('{"NaturalReasoning": "one\\ntwo"}',)),
        ("Answer the question from", ("Done.",)),
    ),
    default=(_GOOD,),
)

SFT_TOKENS, PROMPT_TOKENS = 8192, 1000  # the length limits of training


def _mcq(spark: SparkSession, d: str, *c: str) -> DataFrame:
    return latest_delivery(load(spark, d, "mcq", "process_id", "arrived_at", *c), "process_id")


def _verifiable(spark: SparkSession, d: str, *c: str) -> DataFrame:
    return latest_delivery(load(spark, d, "verifiable", "process_id", "arrived_at", *c), "process_id")


def _sft(spark: SparkSession, d: str, *c: str) -> DataFrame:
    return latest_delivery(load(spark, d, "sft", "sft_id", "arrived_at", *c), "sft_id")


def _events(spark: SparkSession, d: str, *c: str) -> DataFrame:
    return latest_delivery(load(spark, d, "search_event", "event_id", "arrived_at", *c), "event_id")


def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    return relational.assign_ids(_mcq(spark, d, "created_at").select("process_id", "created_at"), ["created_at", "process_id"], "seq").select("process_id", "seq")


def limited(spark: SparkSession, d: str) -> DataFrame:
    return relational.limit_by_id(_mcq(spark, d, "answer"), 100).select("process_id", "answer")


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return relational.resume(_mcq(spark, d, "answer"), load(spark, d, "verifiable", "process_id")).select("process_id", "answer")


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "eval_item", F.col("item_id").alias("id"), "question", "source")
    return relational.union_sources({"held_out": items, "training": _mcq(spark, d, "question").select(F.col("process_id").alias("id"), "question")}).select("source", "id", F.md5("question").alias("digest"))


def pass_filter(spark: SparkSession, d: str) -> DataFrame:
    df = _verifiable(spark, d, "filter_response")
    return df.groupBy(F.coalesce(X.passes(F.col("filter_response")), F.lit(False)).alias("passes")).agg(F.count("*").alias("n"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "kind", "response").filter("kind = 'verify'").select("event_id", F.coalesce(X.verdict(F.col("response")), F.lit(False)).alias("verdict"))


def non_empty_records(spark: SparkSession, d: str) -> DataFrame:
    return _verifiable(spark, d, "open_question", "gold_answer").filter(relational.non_empty("open_question", "gold_answer")).select("process_id", "gold_answer")


def key_presence(spark: SparkSession, d: str) -> DataFrame:
    return _verifiable(spark, d, "reformat_response").filter(relational.has_keys("reformat_response", jsonx.QUESTION_KEY, jsonx.ANSWER_KEY)).select("process_id")


def bracket_content(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "response").select("event_id", F.md5(X.bracket_content(F.col("response"))).alias("digest"))


def validated_steps(spark: SparkSession, d: str) -> DataFrame:
    df = _events(spark, d, "kind", "response").filter(F.col("kind").isin("init", "rethink", "label"))
    return df.select("event_id", jsonx.parse_steps(F.col("response"))["ok"].alias("ok"))


def validated_rewrites(spark: SparkSession, d: str) -> DataFrame:
    df = _events(spark, d, "kind", "response").filter("kind = 'rewrite'").withColumn("p", jsonx.parse_rewrite(F.col("response")))
    return df.select("event_id", F.col("p.ok").alias("ok"), F.md5("p.text").alias("digest"))


def reformatted(spark: SparkSession, d: str) -> DataFrame:
    df = _verifiable(spark, d, "reformat_response").withColumn("p", jsonx.parse_reformat(F.col("reformat_response")))
    return df.filter("p.ok").select("process_id", F.md5("p.question").alias("question"), F.col("p.answer").alias("answer"))


def trajectory_text(spark: SparkSession, d: str) -> DataFrame:
    df = _events(spark, d, "steps").filter(F.size("steps") > 0)
    s = F.col("steps")
    return df.select("event_id", F.md5(X.stream_of_search(s)).alias("digest"), X.final_conclusion(s).alias("conclusion"), F.size(X.without_last(s)).cast("long").alias("kept"), X.valid_steps(s).alias("valid"))


def strategy_choice(spark: SparkSession, d: str) -> DataFrame:
    df = _events(spark, d, "kind", "round").filter("kind = 'rethink'")
    return df.select("event_id", relational.choose(STRATEGIES, F.col("event_id").cast("string"), F.lit("0"), skip_first=F.col("round") == 0).alias("strategy"))


def curate_stub(spark: SparkSession, d: str) -> DataFrame:
    out = curate(_mcq(spark, d, "question", "options", "answer"), STUB)
    return out.withColumn("finished", F.col("open_question").isNotNull() | F.col("filter_response").isNotNull()).groupBy("finished", F.col("open_question").isNotNull().alias("has_question")).agg(F.count("*").alias("n"))


def curate_finished(spark: SparkSession, d: str) -> DataFrame:
    return finished(_verifiable(spark, d, "open_question", "filter_response")).select("process_id")


def search_stub(spark: SparkSession, d: str) -> DataFrame:
    out = search(_verifiable(spark, d, "open_question", "gold_answer"), STUB, SearchConfig(attempts=1, depth=2))
    return merged(out).select("process_id", "calls", F.array_join("response_type", ",").alias("types"))


def search_chinese_stub(spark: SparkSession, d: str) -> DataFrame:
    out = search(_verifiable(spark, d, "open_question", "gold_answer"), STUB, SearchConfig(attempts=2, depth=1, language="zh"))
    return merged(out).select("process_id", "calls", "archived")


def search_log_stub(spark: SparkSession, d: str) -> DataFrame:
    log = search_with_events(_verifiable(spark, d, "open_question", "gold_answer"), STUB, SearchConfig(attempts=1, depth=2))[1]
    return log.select("process_id", "attempt", "round", "kind", "strategy", "verdict", "valid", F.size("steps").cast("long").alias("n_steps"), F.col("error").isNotNull().alias("failed"))


def search_state(spark: SparkSession, d: str) -> DataFrame:
    df = _events(spark, d, "process_id", "attempt", "round", "kind", "verdict").filter("kind = 'verify'")
    last = F.max_by(F.col("verdict").cast("boolean"), F.struct("attempt", "round", "event_id"))
    return df.groupBy("process_id").agg(F.count("*").alias("rounds"), F.coalesce(last, F.lit(False)).alias("solved"))


def sft_render(spark: SparkSession, d: str) -> DataFrame:
    return sft.render(_sft(spark, d, "question", "complex_cot", "response"), "question", "complex_cot", "response").select("sft_id", F.md5("prompt").alias("prompt"), F.md5("full").alias("full"))


def _tokens(spark: SparkSession, d: str, most: int = SFT_TOKENS) -> DataFrame:
    return sft.masked_tokens(sft.render(_sft(spark, d, "question", "complex_cot", "response"), "question", "complex_cot", "response"), most)


def _token_digests(df: DataFrame) -> DataFrame:
    join = lambda c: F.md5(F.array_join(c, ","))
    return df.select("sft_id", F.size("input_ids").cast("long").alias("n"), join("input_ids").alias("ids"), join("labels").alias("labels"))


def sft_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _token_digests(_tokens(spark, d))


def sft_batches(spark: SparkSession, d: str) -> DataFrame:
    out = sft.padded(relational.batches(_tokens(spark, d), 16, "sft_id", first=0), "batch_id", SFT_TOKENS, pad=0)
    return out.select("sft_id", "batch_id", F.size("input_ids").cast("long").alias("n"), F.md5(F.array_join("input_ids", ",")).alias("ids"), F.md5(F.array_join("labels", ",")).alias("labels"))


def prompt_batches(spark: SparkSession, d: str) -> DataFrame:
    df = _verifiable(spark, d, "open_question", "gold_answer").filter(relational.non_empty("open_question", "gold_answer"))
    df = df.select("process_id", sft.word_ids(X.chat([("user", F.col("open_question"))], ask=True)).alias("input_ids"))
    out = sft.padded(relational.batches(df, 32, "process_id", first=0), "batch_id", PROMPT_TOKENS, pad=7, left=True, columns={"input_ids": 7})
    return out.select("process_id", F.size("input_ids").cast("long").alias("n"), F.md5(F.array_join("input_ids", ",")).alias("ids"))


def stop_cut(spark: SparkSession, d: str) -> DataFrame:
    stop = F.get(sft.word_ids(F.lit("the")), F.lit(0))
    ids = _sft(spark, d, "response").withColumn("ids", sft.word_ids(F.col("response"))).withColumn("stop", stop)
    at = A.first_index(F.col("ids"), F.col("stop"))
    cut = A.cut_at_stop(F.col("ids"), F.col("stop"), -1)
    return ids.select("sft_id", at.cast("long").alias("at"), F.array_contains("ids", F.col("stop")).alias("has_stop"), F.md5(F.array_join(cut, ",")).alias("ids"))


def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    df = _sft(spark, d, "source", "response", "complex_cot")
    df = df.withColumn("labels", sft.word_ids(F.col("response"))).withColumn("predicted", sft.word_ids(F.col("complex_cot")))
    right, n = sft.token_hits(F.col("predicted"), F.col("labels"))
    out = sft.metric(df.select("source", right.alias("right"), n.alias("total"), F.size("labels").cast("double").alias("loss")), ["source"])
    return out.select("source", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


def rl_split(spark: SparkSession, d: str) -> DataFrame:
    return relational.split(_verifiable(spark, d, "open_question").select("process_id"), "process_id").select("process_id", "split")


def step_labels(spark: SparkSession, d: str) -> DataFrame:
    df = _events(spark, d, "steps").filter(F.size("steps") > 0)
    labels = F.transform("steps", lambda s, i: (F.length(F.coalesce(s["content"], F.lit(""))) % 5 > 0).cast("int"))
    scores = F.transform("steps", lambda s, i: F.length(F.coalesce(s["content"], F.lit(""))) / 100)
    return df.select("event_id", extensions.first_wrong(labels).cast("long").alias("first_wrong"), F.round(extensions.process_reward(scores), 6).alias("reward"))


def repeated_text(spark: SparkSession, d: str) -> DataFrame:
    return _sft(spark, d, "complex_cot").select("sft_id", F.round(extensions.repetition(F.col("complex_cot")), 6).alias("repetition"))


def prefixed_keys(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("policy.status"), F.col("o_orderstatus"), F.lit("policy.priority"), F.col("o_orderpriority"), F.lit("value.head"), F.lit("x"))
    more = relational.merged(relational.prefixed(m, "policy."), F.create_map(F.lit("status"), F.lower("o_orderstatus")))
    return load(spark, d, "orders").select("o_orderkey", F.size(more).cast("long").alias("n"), more["status"].alias("status"), more["priority"].alias("priority"))


QUERIES = {
    f.__name__: f
    for f in (
        assigned_ids, limited, resume_anti_join, union_sources, pass_filter, verdicts, non_empty_records, key_presence, bracket_content, validated_steps, validated_rewrites, reformatted, trajectory_text, strategy_choice,
        curate_stub, curate_finished, search_stub, search_chinese_stub, search_log_stub, search_state, sft_render, sft_tokens, sft_batches, prompt_batches, stop_cut, token_accuracy, rl_split, step_labels, repeated_text, prefixed_keys,
    )
}


def _once(table: str, key: str) -> str:
    return f"{table}_1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY arrived_at DESC) AS rn FROM {table}) WHERE rn = 1)"


_M, _V, _S, _E = _once("mcq", "process_id"), _once("verifiable", "process_id"), _once("sft", "sft_id"), _once("search_event", "event_id")
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_USER = "'<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || " + _TRIM.format("{}") + " || '<|eot_id|>'"
_ASK = "'<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"
_ANSWER = _TRIM.format("'## Thinking' || chr(10) || chr(10) || complex_cot || chr(10) || chr(10) || '## Final Response' || chr(10) || chr(10) || response")
_FULL = f"{_USER.format('question')} || {_ASK} || {_ANSWER} || '<|eot_id|>'"
_IDS = r"list_transform(list_filter(string_split_regex(coalesce({}, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 6))::INT)"
_TOK = f"""{_S}, r AS (SELECT sft_id, {_USER.format('question')} || {_ASK} AS prompt, {_FULL} AS ful FROM sft_1),
t AS (SELECT sft_id, {_IDS.format('ful')} AS ids, len({_IDS.format('prompt')}) AS k FROM r),
l AS (SELECT sft_id, ids[-8192:] AS ids, list_transform(ids, lambda x, i: CASE WHEN i <= k THEN -100 ELSE x END)[-8192:] AS labels FROM t)"""
_CHOICE = "['Backtracking', 'Exploring New Paths', 'Verification', 'Correction']"



def filled_sql(template: str, **slots: str) -> str:
    """text.fill in SQL: the template with SQL expressions in its slots."""
    parts = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{(\w+)\}", template):
        parts.append(slots[name] if name else "'" + literal.replace("{{", "{").replace("}}", "}").replace("'", "''") + "'")
    return " || ".join(parts)


_NUMBER = "('0x' || substr(md5({}), 1, 8))::BIGINT"  # of a text, as the stub takes it
_BLOCK = "question || chr(10) || array_to_string(list_transform(options, lambda o: o.label || '. ' || o.text), chr(10))"
_P = prompt_set()
_CURATED = f"""WITH {_M}, q AS (SELECT {filled_sql(_P['filter'], question=_BLOCK, answer='answer')} AS f, {filled_sql(_P['reformat'], question=_BLOCK, answer='answer')} AS r FROM mcq_1),
s AS (SELECT f IS NOT NULL AS sent, coalesce({_NUMBER.format('f')} % 2 = 0 AND {_NUMBER.format('r')} % 2 = 0, false) AS good FROM q)"""
# the stub's conclusion is always the same, and so is then a record's verdict
_SEARCHED = f"""WITH {_V}, s AS (SELECT process_id, {_NUMBER.format(filled_sql(_P['verify'], conclusion="'c1'", answer="coalesce(gold_answer, '')"))} % 3 = 0 AS ok,
{_CHOICE}[({_NUMBER.format("process_id || '|0|0|0'")} % 3 + 2)::INT] AS s0, {_CHOICE}[({_NUMBER.format("process_id || '|0|1|0'")} % 4 + 1)::INT] AS s1 FROM verifiable_1 WHERE open_question IS NOT NULL)"""
_CALLS = [("true", 0, 0, "init", "NULL", "NULL", 3), ("true", 0, 0, "verify", "NULL", "ok", -1), ("NOT ok", 0, 0, "rethink", "s0", "NULL", 3), ("NOT ok", 0, 1, "verify", "NULL", "ok", -1), ("NOT ok", 0, 1, "rethink", "s1", "NULL", 3), ("NOT ok", 0, 2, "verify", "NULL", "ok", -1), ("NOT ok", 0, 2, "label", "NULL", "NULL", 3), ("true", 0, 2, "rewrite", "NULL", "NULL", -1), ("true", 0, 2, "final", "NULL", "NULL", -1)]
_N_STEPS = lambda n: "NULL" if n < 0 else str(n)

ORACLE = {
    "assigned_ids": f"WITH {_M} SELECT process_id, row_number() OVER (ORDER BY created_at, process_id) AS seq FROM mcq_1",
    "limited": f"WITH {_M} SELECT process_id, answer FROM mcq_1 WHERE process_id <= 100",
    "resume_anti_join": f"WITH {_M} SELECT process_id, answer FROM mcq_1 ANTI JOIN verifiable USING (process_id)",
    "union_sources": f"WITH {_M} SELECT 'held_out' AS source, item_id AS id, md5(question) AS digest FROM eval_item UNION ALL SELECT 'training', process_id, md5(question) FROM mcq_1",
    "pass_filter": f"WITH {_V} SELECT coalesce(contains(lower(filter_response), 'pass'), false) AS passes, count(*) AS n FROM verifiable_1 GROUP BY 1",
    "verdicts": f"WITH {_E} SELECT event_id, coalesce(contains(lower(response), 'true'), false) AS verdict FROM search_event_1 WHERE kind = 'verify'",
    "non_empty_records": f"WITH {_V} SELECT process_id, gold_answer FROM verifiable_1 WHERE length(open_question) > 0 AND length(gold_answer) > 0",
    "key_presence": f"WITH {_V} SELECT process_id FROM verifiable_1 WHERE CASE WHEN json_valid(reformat_response) THEN json_exists(reformat_response, '$.\"Open-ended Verifiable Question\"') AND json_exists(reformat_response, '$.\"Ground-True Answer\"') END",
    "bracket_content": rf"WITH {_E} SELECT event_id, md5(nullif(regexp_extract(response, '(?s)\{{.*\}}'), '')) AS digest FROM search_event_1",
    "validated_steps": f"WITH {_E} SELECT event_id, valid AS ok FROM search_event_1 WHERE kind IN ('init', 'rethink', 'label')",
    "validated_rewrites": rf"""WITH {_E}, j AS (SELECT event_id, replace(CASE WHEN starts_with(response, '{{') THEN response ELSE nullif(regexp_extract(response, '(?s)\{{.*\}}'), '') END, chr(10), '') AS j FROM search_event_1 WHERE kind = 'rewrite'),
t AS (SELECT event_id, CASE WHEN json_valid(j) THEN j ->> '$.NaturalReasoning' END AS t FROM j) SELECT event_id, coalesce(contains(t, chr(10)), false) AS ok, CASE WHEN contains(t, chr(10)) THEN md5(t) END AS digest FROM t""",
    "reformatted": rf"""WITH {_V}, j AS (SELECT process_id, replace(CASE WHEN starts_with(reformat_response, '{{') THEN reformat_response ELSE nullif(regexp_extract(reformat_response, '(?s)\{{.*\}}'), '') END, chr(10), '') AS j FROM verifiable_1),
g AS (SELECT * FROM j WHERE json_valid(j)) SELECT process_id, md5(j ->> '$."Open-ended Verifiable Question"') AS question, j ->> '$."Ground-True Answer"' AS answer FROM g
WHERE len(json_keys(j)) = 2 AND json_type(j, '$."Open-ended Verifiable Question"') = 'VARCHAR' AND json_type(j, '$."Ground-True Answer"') = 'VARCHAR'""",
    "trajectory_text": f"""WITH {_E} SELECT event_id, md5({_TRIM.format("array_to_string(list_transform(steps, lambda s: '### ' || CASE WHEN s.has_title THEN s.title ELSE replace(s.action, 'Final Conclusion', 'Conclusion') END || chr(10) || s.content || chr(10)), chr(10))")}) AS digest,
steps[-2].content AS conclusion, (len(steps) - 1)::BIGINT AS kept,
coalesce(len(steps) >= 3 AND steps[-3].action = 'Inner Thinking' AND steps[-2].action = 'Final Conclusion' AND steps[-1].action = 'Verification', false) AS valid FROM search_event_1 WHERE len(steps) > 0""",
    "strategy_choice": f"""WITH {_E}, h AS (SELECT event_id, round, ('0x' || substr(md5(event_id || '|0'), 1, 8))::BIGINT AS h FROM search_event_1 WHERE kind = 'rethink')
SELECT event_id, CASE WHEN round = 0 THEN {_CHOICE}[(h % 3 + 2)::INT] ELSE {_CHOICE}[(h % 4 + 1)::INT] END AS strategy FROM h""",
    "curate_stub": f"{_CURATED} SELECT sent AS finished, good AS has_question, count(*) AS n FROM s GROUP BY ALL",
    "search_stub": f"{_SEARCHED} SELECT process_id, CASE WHEN ok THEN 4 ELSE 9 END AS calls, CASE WHEN ok THEN 'Init_CoT' ELSE 'Init_CoT,Re_CoT_' || s0 || ',Re_CoT_' || s1 || ',Label_CoT' END AS types FROM s",
    "search_chinese_stub": f"{_SEARCHED} SELECT process_id, CASE WHEN ok THEN 4 ELSE 9 END AS calls, CASE WHEN ok THEN 0 ELSE 1 END AS archived FROM s",
    "search_log_stub": f"{_SEARCHED} " + " UNION ALL ".join(f"SELECT process_id, {a} AS attempt, {r} AS round, '{k}' AS kind, {s}::VARCHAR AS strategy, {v}::BOOLEAN AS verdict, true AS valid, {_N_STEPS(n)}::BIGINT AS n_steps, false AS failed FROM s WHERE {c}" for c, a, r, k, s, v, n in _CALLS),
    "curate_finished": f"WITH {_V} SELECT process_id FROM verifiable_1 WHERE open_question IS NOT NULL OR filter_response IS NOT NULL",
    "search_state": f"WITH {_E} SELECT process_id, count(*) AS rounds, coalesce(arg_max(verdict, (attempt, round, event_id)), false) AS solved FROM search_event_1 WHERE kind = 'verify' GROUP BY 1",
    "sft_render": f"WITH {_S} SELECT sft_id, md5({_USER.format('question')} || {_ASK}) AS prompt, md5({_FULL}) AS \"full\" FROM sft_1",
    "sft_tokens": f"WITH {_TOK} SELECT sft_id, len(ids)::BIGINT AS n, md5(coalesce(array_to_string(ids, ','), '')) AS ids, md5(coalesce(array_to_string(labels, ','), '')) AS labels FROM l",
    "sft_batches": f"""WITH {_TOK}, b AS (SELECT *, floor(sft_id / 16)::BIGINT AS batch_id, least(max(len(ids)) OVER (PARTITION BY floor(sft_id / 16)), 8192)::INT AS w FROM l),
q AS (SELECT sft_id, batch_id, list_resize(ids[1:w], w, 0) AS ids, list_resize(labels[1:w], w, -100) AS labels FROM b)
SELECT sft_id, batch_id, len(ids)::BIGINT AS n, md5(coalesce(array_to_string(ids, ','), '')) AS ids, md5(coalesce(array_to_string(labels, ','), '')) AS labels FROM q""",
    "prompt_batches": f"""WITH {_V}, t AS (SELECT process_id, floor(process_id / 32)::BIGINT AS b, {_IDS.format(_USER.format('open_question') + ' || ' + _ASK)} AS ids FROM verifiable_1 WHERE length(open_question) > 0 AND length(gold_answer) > 0),
w AS (SELECT *, least(max(len(ids)) OVER (PARTITION BY b), 1000)::INT AS w FROM t), q AS (SELECT process_id, list_concat(list_transform(range(greatest(w - len(ids), 0)), lambda x: 7), ids[1:w]) AS ids FROM w)
SELECT process_id, len(ids)::BIGINT AS n, md5(array_to_string(ids, ',')) AS ids FROM q""",
    "stop_cut": f"""WITH {_S}, t AS (SELECT sft_id, {_IDS.format('response')} AS ids, ('0x' || substr(md5('the'), 1, 6))::INT AS stop FROM sft_1), a AS (SELECT *, coalesce(list_position(ids, stop) - 1, len(ids))::BIGINT AS pos FROM t)
SELECT sft_id, pos AS "at", list_contains(ids, stop) AS has_stop, md5(coalesce(array_to_string(list_transform(ids, lambda x, i: CASE WHEN i - 1 > pos THEN -1 ELSE x END), ','), '')) AS ids FROM a""",
    "token_accuracy": f"""WITH {_S}, t AS (SELECT source, {_IDS.format('response')} AS l, {_IDS.format('complex_cot')} AS p FROM sft_1),
h AS (SELECT source, greatest(len(l) - 1, 0) AS n, len(l) AS len, len(list_filter(range(2, len(l) + 1), lambda i: l[i] = p[i - 1])) AS r FROM t)
SELECT source, round(sum(r)::DOUBLE / nullif(sum(n), 0), 6) AS accuracy, round(avg(len), 6) AS loss FROM h GROUP BY source""",
    "rl_split": f"WITH {_V}, r AS (SELECT process_id, row_number() OVER (ORDER BY md5(process_id || '|42'), process_id) AS k, count(*) OVER () AS n FROM verifiable_1) SELECT process_id, CASE WHEN k <= least(floor(0.1 * n), 200) THEN 'eval' ELSE 'train' END AS split FROM r",
    "step_labels": f"""WITH {_E}, s AS (SELECT event_id, list_transform(steps, lambda x: length(coalesce(x.content, ''))) AS n FROM search_event_1 WHERE len(steps) > 0)
SELECT event_id, (list_position(list_transform(n, lambda x: (x % 5 > 0)::INT), 0) - 1)::BIGINT AS first_wrong, round(0.5 * list_min(n) / 100 + 0.5 * list_avg(n) / 100, 6) AS reward FROM s""",
    "repeated_text": rf"""WITH {_S}, w AS (SELECT sft_id, list_filter(string_split_regex(lower(complex_cot), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM sft_1),
g AS (SELECT sft_id, CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END AS g FROM w) SELECT sft_id, round(coalesce(1 - len(list_distinct(g))::DOUBLE / len(g), 0), 6) AS repetition FROM g""",
    "prefixed_keys": "SELECT o_orderkey, 2::BIGINT AS n, lower(o_orderstatus) AS status, o_orderpriority AS priority FROM orders",
}
ORACLE |= {
}
