"""Queries of files in and out, batches, samples and small aggregates; with their SQL.

The files are written to the shared folder first and read back, so each query tests a writer and a reader.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.operators import answers, extensions, relational, rl, sft
from veriloom.plans.answer_queries import ORACLE as _ANSWERS
from veriloom.plans.answer_queries import _extracted
from veriloom.plans.record_queries import _E, _IDS, _S, _V, _sft, _verifiable
from veriloom.plans.search import merged
from veriloom.session import shared_dir, written
from veriloom.sources import json_files
from veriloom.sources.tables import latest_delivery, load

_ITEM = "item_id long, source string, question string, answer_idx string, options array<struct<label:string,text:string>>"


def _folder(spark: SparkSession, tag: str) -> str:
    return written(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The held-out items: a fixed table of some hundred rows, which fit into one file."""
    return load(spark, d, "eval_item", "item_id", "source", "question", "answer_idx", "options")


def array_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "array")
    one = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ","), F.lit("]"))
    _items(spark, d).agg(one).write.text(path)
    df = json_files.read_array(spark, path, _ITEM)
    return df.select("item_id", "source", "answer_idx", F.md5("question").alias("digest"), F.size("options").cast("long").alias("n_options"))


def named_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "named")
    record = F.to_json(F.struct("item_id", "question", "answer_idx"))
    per = _items(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("item_id", record.alias("j")))).alias("x"))
    entry = F.concat(F.lit('"'), "source", F.lit('":['), F.array_join(F.transform("x", lambda x: x["j"]), ","), F.lit("]"))
    per.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}"))).write.text(path)
    df = json_files.read_named(spark, path, "item_id long, question string, answer_idx string")
    return df.select("source", F.col("pos").cast("long").alias("pos"), "item_id", "answer_idx", F.md5("question").alias("digest"))


def record_folder(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "records")
    _items(spark, d).select("item_id", F.when(F.col("item_id") % 3 > 0, F.col("answer_idx")).alias("a"), F.when(F.col("item_id") % 2 > 0, F.col("source")).alias("b")).write.option("maxRecordsPerFile", 1).json(path)
    return json_files.read_records(spark, path, "item_id long, a string, b string", any_of=["a", "b"])


def merged_records(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "records")
    rows = _sft(spark, d, "complex_cot", "response").select("sft_id", "complex_cot", "response")
    json_files.write_lines(rows, path)
    return merged(spark.read.schema(rows.schema).json(path)).select("sft_id", F.md5("complex_cot").alias("cot"), F.md5("response").alias("response"))


def stage_table(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "stage")
    rows = _verifiable(spark, d, "gold_answer").select("process_id", "gold_answer")
    json_files.append_stage(rows.withColumn("gold_answer", F.lit("first")), path)
    json_files.append_stage(rows.filter(F.col("process_id") % 2 == 0), path)
    return json_files.read_stage(spark, path, "process_id").select("process_id", "gold_answer")


def lines_export(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "lines")
    rows = _verifiable(spark, d, "open_question", "gold_answer").select("process_id", "open_question", "gold_answer")
    json_files.write_lines(rows, path, order=["process_id"])
    return spark.read.schema(rows.schema).json(path).select("process_id", F.md5("open_question").alias("question"), "gold_answer")


def score_file(spark: SparkSession, d: str) -> DataFrame:
    told = json_files.score_dict(answers.score(_extracted(spark, d, fuzzy=False), ignore_miss=True))
    rows = [(k, *v) for k, v in told.items()]
    return spark.createDataFrame(rows, "source string, score double, head_hits long, total long, tail_hits long").withColumn("score", F.round("score", 6))


def _ids(spark: SparkSession, d: str) -> DataFrame:
    stop = F.get(sft.word_ids(F.lit("the")), F.lit(0))
    return _sft(spark, d, "source", "response").withColumn("ids", sft.word_ids(F.col("response"))).withColumn("stop", stop)


def eos_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).groupBy("source").agg(rl.eos_count(F.col("ids"), F.col("stop")).alias("n"))


def eos_penalty(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("sft_id", rl.missing_eos_penalty(F.size("ids").cast("double"), F.col("ids"), F.col("stop"), 1.5).alias("score"))


def full_batches(spark: SparkSession, d: str) -> DataFrame:
    return relational.batches(load(spark, d, "orders", "o_orderkey"), 64, "o_orderkey", drop_last=True, first=0)


def first_batch(spark: SparkSession, d: str) -> DataFrame:
    return relational.first_batch(relational.batches(load(spark, d, "orders", "o_orderkey", "o_totalprice"), 1024, "o_orderkey", first=0), 5, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def epoch_rows(spark: SparkSession, d: str) -> DataFrame:
    e = relational.epochs(load(spark, d, "customer", "c_custkey"), 3, "c_custkey")
    return e.groupBy("epoch").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("keys"), F.count_distinct("shuffle_key").alias("places"))


def bernoulli_sample(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "user_id")
    return relational.bernoulli(e, 0.1, F.col("event_id").cast("string"), seed=relational.rank_seed(42, F.col("user_id") % 8))


def appended_batches(spark: SparkSession, d: str) -> DataFrame:
    c, s = load(spark, d, "customer", F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation")), load(spark, d, "supplier", F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return relational.appended([c, s]).groupBy("part", "nation").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


def concatenated_ids(spark: SparkSession, d: str) -> DataFrame:
    df = _sft(spark, d, "question", "response").select("sft_id", relational.concatenated(sft.word_ids(F.col("question")), sft.word_ids(F.col("response"))).alias("ids"))
    return df.select("sft_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids"))


def run_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, rl.batch_sizes(n, 1, 16, 1, 8)["batch"], rl.batch_sizes(n, 1, 16, 1, 8)["updates"], rl.interval(0.1, n), rl.interval(7, n)) for n in (1, 128, 129, 20000)]
    return spark.createDataFrame(rows, "episodes long, batch long, updates long, tenth long, fixed long")


def fixed_split(spark: SparkSession, d: str) -> DataFrame:
    both = relational.union_sources({"items": _items(spark, d).select(F.col("item_id").alias("id")), "orders": load(spark, d, "orders", F.col("o_orderkey").alias("id"))})
    out = extensions.hash_split(both, "id", {"train": 0.8, "dev": 0.1, "test": 0.1})
    again = extensions.hash_split(both.repartition(3), "id", {"train": 0.8, "dev": 0.1, "test": 0.1})
    same = out.join(again.select("source", "id", F.col("split").alias("second")), ["source", "id"])
    share = lambda s: F.avg((F.col("split") == s).cast("double"))
    near = lambda s, x: F.abs(share(s) - x) < 0.1
    return same.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("split") == F.col("second")).alias("stable"), (near("train", 0.8) & near("dev", 0.1) & near("test", 0.1)).alias("near"))


def four_candidates(spark: SparkSession, d: str) -> DataFrame:
    return extensions.candidates(_items(spark, d).select("item_id")).withColumn("candidate", F.col("candidate").cast("long"))


def stage_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_type", "user_id", "value").withColumn("stage", F.concat(F.lit("s"), F.col("user_id") % 4))
    out = extensions.compared(e, "value", "event_type", "stage", ["s0", "s1", "s2", "s3"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("s0", "s1", "s2", "s3")])


def limited_prompts(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("question", r"\s+"), lambda w: w != "")
    kept = X.keep_limit(F.col("question"), words, 40, lambda w: F.array_join(w, " "))
    return _items(spark, d).select("item_id", F.md5(kept).alias("digest"))


def steps_text(spark: SparkSession, d: str) -> DataFrame:
    df = latest_delivery(load(spark, d, "search_event", "event_id", "arrived_at", "steps"), "event_id").filter(F.size("steps") > 0)
    return df.select("event_id", F.md5(X.steps_json(F.col("steps"))).alias("digest"))


def throughput(spark: SparkSession, d: str) -> DataFrame:
    per = load(spark, d, "events", "user_id", "ts").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    return per.select("user_id", rl.throughput(F.col("n") * 1000000, F.col("a"), F.col("b")).alias("rate"))


def copied_files(spark: SparkSession, d: str) -> DataFrame:
    ending = F.when(F.col("p_size") % 4 == 0, ".bin").when(F.col("p_size") % 4 == 1, ".safetensors").when(F.col("p_size") % 4 == 2, ".index.json").otherwise(".json")
    name = F.concat(F.when(F.col("p_size") % 3 == 0, F.lit("pytorch_model-")).otherwise("part-"), F.col("p_partkey").cast("string"), ending)
    return load(spark, d, "part", "p_partkey", "p_size").withColumn("name", name).filter(json_files.copied(F.col("name"))).select("p_partkey", "name")


QUERIES = {
    f.__name__: f
    for f in (
        array_file, named_file, record_folder, merged_records, stage_table, lines_export, score_file, eos_tokens, eos_penalty, full_batches, first_batch, epoch_rows, bernoulli_sample, appended_batches, concatenated_ids, run_sizes, fixed_split, four_candidates, stage_pivot, limited_prompts, steps_text, throughput, copied_files,
    )
}

_STOP = "('0x' || substr(md5('the'), 1, 6))::INT"

ORACLE = {
    "array_file": "SELECT item_id, source, answer_idx, md5(question) AS digest, len(options)::BIGINT AS n_options FROM eval_item",
    "named_file": "SELECT source, row_number() OVER (PARTITION BY source ORDER BY item_id) - 1 AS pos, item_id, answer_idx, md5(question) AS digest FROM eval_item",
    "record_folder": "SELECT item_id, CASE WHEN item_id % 3 > 0 THEN answer_idx END AS a, CASE WHEN item_id % 2 > 0 THEN source END AS b FROM eval_item WHERE item_id % 3 > 0 AND answer_idx IS NOT NULL OR item_id % 2 > 0 AND source IS NOT NULL",
    "merged_records": f"WITH {_S} SELECT sft_id, md5(complex_cot) AS cot, md5(response) AS response FROM sft_1 WHERE complex_cot IS NOT NULL AND response IS NOT NULL",
    "stage_table": f"WITH {_V} SELECT process_id, CASE WHEN process_id % 2 = 0 THEN gold_answer ELSE 'first' END AS gold_answer FROM verifiable_1",
    "lines_export": f"WITH {_V} SELECT process_id, md5(open_question) AS question, gold_answer FROM verifiable_1",
    "eos_tokens": f"WITH {_S} SELECT source, sum(len(list_filter({_IDS.format('response')}, lambda x: x = {_STOP})))::BIGINT AS n FROM sft_1 GROUP BY 1",
    "eos_penalty": f"WITH {_S}, t AS (SELECT sft_id, {_IDS.format('response')} AS ids FROM sft_1) SELECT sft_id, len(ids)::DOUBLE - CASE WHEN list_contains(ids, {_STOP}) THEN 0 ELSE 1.5 END AS score FROM t",
    "score_file": _ANSWERS["score_strict"],
    "full_batches": "SELECT o_orderkey, o_orderkey // 64 AS batch_id FROM orders WHERE o_orderkey // 64 < (SELECT (max(o_orderkey) + 1) // 64 FROM orders)",
    "first_batch": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey // 1024 = 0 ORDER BY o_orderkey LIMIT 5",
    "epoch_rows": "SELECT e::INT AS epoch, count(*) AS n, count(DISTINCT c_custkey) AS keys, count(DISTINCT c_custkey) AS places FROM customer, range(3) AS r(e) GROUP BY 1",
    "bernoulli_sample": f"SELECT event_id, user_id FROM events WHERE ('0x' || substr(md5(event_id || '|' || (42 + (user_id % 8) * 100003)), 1, 8))::BIGINT < {int(0.1 * 2**32)}",
    "appended_batches": "SELECT 0 AS part, c_nationkey AS nation, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 2 UNION ALL SELECT 1, s_nationkey, count(*), sum(s_suppkey)::BIGINT FROM supplier GROUP BY 2",
    "concatenated_ids": f"WITH {_S}, t AS (SELECT sft_id, list_concat({_IDS.format('question')}, {_IDS.format('response')}) AS ids FROM sft_1) SELECT sft_id, len(ids)::BIGINT AS n, md5(coalesce(array_to_string(ids, ','), '')) AS ids FROM t",
    "run_sizes": "SELECT e::BIGINT AS episodes, 128::BIGINT AS batch, ceil(e / 128.0)::BIGINT AS updates, ceil(0.1 * e)::BIGINT AS tenth, 7::BIGINT AS fixed FROM (VALUES (1), (128), (129), (20000)) AS t(e)",
    "fixed_split": "SELECT 'items' AS source, count(*) AS n, count(*) AS stable, true AS near FROM eval_item UNION ALL SELECT 'orders', count(*), count(*), true FROM orders",
    "four_candidates": "SELECT item_id, c AS candidate FROM eval_item, range(4) AS r(c)",
    "stage_pivot": "SELECT event_type, " + ", ".join(f"round(avg(value) FILTER (WHERE user_id % 4 = {i}), 6) AS s{i}" for i in range(4)) + " FROM events GROUP BY 1",
    "steps_text": f"""WITH {_E}, t AS (SELECT event_id, list_transform(steps[1:len(steps) - 1], lambda s: '  {{' || chr(10) || array_to_string(list_filter(['    "action": ' || coalesce(to_json(s.action)::VARCHAR, 'null'), CASE WHEN s.has_title THEN '    "title": ' || coalesce(to_json(s.title)::VARCHAR, 'null') END, '    "content": ' || coalesce(to_json(s.content)::VARCHAR, 'null')], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '  }}') AS l FROM search_event_1 WHERE len(steps) > 0)
SELECT event_id, md5(CASE WHEN len(l) = 0 THEN '[]' ELSE '[' || chr(10) || array_to_string(l, ',' || chr(10)) || chr(10) || ']' END) AS digest FROM t""",
    "throughput": "SELECT user_id, floor(count(*) * 1000000.0 / nullif(epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT, 0))::BIGINT AS rate FROM events GROUP BY 1",
    "copied_files": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'pytorch_model-' ELSE 'part-' END || p_partkey || CASE p_size % 4 WHEN 0 THEN '.bin' WHEN 1 THEN '.safetensors' WHEN 2 THEN '.index.json' ELSE '.json' END AS name FROM part WHERE p_size % 4 = 3 OR p_size % 4 = 0 AND p_size % 3 > 0",
    "limited_prompts": r"WITH w AS (SELECT item_id, question, list_filter(string_split_regex(question, '\s+'), lambda x: x <> '') AS w FROM eval_item) SELECT item_id, md5(CASE WHEN len(w) > 40 THEN array_to_string(w[1:40], ' ') ELSE right(question, 40) END) AS digest FROM w",
}
