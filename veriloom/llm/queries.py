"""Queries of the problems on text data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import language, leakage, mixing, neardup, pairs, splitting, tokens, truncation
from veriloom.sources.tables import load

FIELDS = ["question", "complex_cot", "response"]


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return language.label_segments(load(spark, d, "sft", "sft_id", "lang", *FIELDS), "sft_id", "lang", FIELDS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(_segments(spark, d)).withColumnRenamed("id", "sft_id")


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.distinct_segments(_segments(spark, d)).drop("declared").withColumnRenamed("id", "sft_id")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    mcq = load(spark, d, "mcq").select(F.lit("mcq").alias("tbl"), F.col("process_id").alias("id"), F.col("question").alias("text"))
    ver = load(spark, d, "verifiable").select(F.lit("verifiable").alias("tbl"), F.col("process_id").alias("id"), F.col("open_question").alias("text"))
    return mcq.unionByName(ver)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.all_pairs(*neardup.links(_questions(spark, d)))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*neardup.links(_questions(spark, d)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "sft", "sft_id", "lang", *FIELDS)
    return pairs.defects(df, "sft_id", "lang", "question", ["complex_cot", "response"]).withColumnRenamed("id", "sft_id")


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    sft = load(spark, d, "sft").select(F.lit("sft").alias("tbl"), F.col("sft_id").alias("record_id"), "source", F.col("complex_cot").alias("text"))
    pred = load(spark, d, "prediction").select(F.lit("prediction").alias("tbl"), F.col("prediction_id").alias("record_id"), "source", F.col("output").alias("text"))
    return truncation.cut_texts(sft.unionByName(pred), evidence=True).dropDuplicates(["tbl", "record_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).filter(F.col("cut").isNotNull()).select("tbl", "record_id")


def p5_cuts(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d)


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(_cuts(spark, d))


def _training(spark: SparkSession, d: str) -> DataFrame:
    sft = load(spark, d, "sft").select(F.lit("sft").alias("tbl"), F.col("sft_id").alias("id"), F.col("question").alias("text"))
    doc = load(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), "text")
    return _questions(spark, d).unionByName(sft).unionByName(doc)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "eval_item").select("item_id", F.col("question").alias("text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_training(spark, d), _items(spark, d)).select("tbl", F.col("id").alias("record_id"), "item_id").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(_training(spark, d), _items(spark, d)).select("tbl", "id", "item_id").distinct()
    return found.groupBy("item_id").agg(*[F.count_if(F.col("tbl") == t).alias(f"n_{t}") for t in ("mcq", "verifiable", "sft", "documents")])


def p6_proximity(spark: SparkSession, d: str) -> DataFrame:
    return leakage.near_leaks(_training(spark, d), _items(spark, d)).withColumnRenamed("id", "record_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(load(spark, d, "documents", "doc_id", "text")).select("doc_id", "ids")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(p7_ids(spark, d), "doc_id")


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    ids = tokens.encode(load(spark, d, "documents", "doc_id", "source", "text"))
    texts = ids.select(F.col("doc_id").alias("key"), "source", F.size("ids").alias("n_tokens"))
    return mixing.mixture(texts, load(spark, d, "source_plan"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(_mixture(spark, d), load(spark, d, "source_plan"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    plan = load(spark, d, "source_plan", "source", "max_tokens", "overlap_tokens")
    docs = load(spark, d, "documents", "doc_id", "source", "text")
    return splitting.split_oversized(docs.join(F.broadcast(plan), "source"))


QUERIES = {"p1_found": p1_found, "p1_segments": p1_segments, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p5_found": p5_found, "p5_cuts": p5_cuts, "p5_rates": p5_rates, "p6_found": p6_found, "p6_items": p6_items, "p6_proximity": p6_proximity, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_pieces": p9_pieces}
_HAN = r"[一-鿿㐀-䶿]"
_RUNS = r"[^\p{L}\p{N}]|[一-鿿㐀-䶿]"
_TEXTS = """t AS (SELECT DISTINCT 'mcq' AS tbl, process_id AS id, question AS text FROM mcq UNION ALL SELECT DISTINCT 'verifiable', process_id, open_question FROM verifiable)"""
_SETS = rf"""{_TEXTS}, r AS (SELECT tbl, id, list_filter(string_split_regex(lower(text), '{_RUNS}'), lambda w: w <> '') AS words, regexp_extract_all(text, '{_HAN}+') AS runs FROM t),
s AS (SELECT tbl, id, list_distinct(list_concat(words, flatten(list_transform(runs, lambda x: CASE WHEN length(x) = 1 THEN [x] ELSE list_transform(range(1, length(x)), lambda i: x[i:i + 1]) END)))) AS words FROM r),
w AS (SELECT tbl, id, len(words) AS n, unnest(words) AS word FROM s)"""
_TRAIN = f"""{_TEXTS}, x AS (SELECT * FROM t UNION ALL SELECT DISTINCT 'sft', sft_id, question FROM sft UNION ALL SELECT 'documents', doc_id, text FROM documents)"""
_WORDS = r"list_filter(string_split_regex(lower(regexp_replace({}, '</?[a-zA-Z][^<>]{{0,80}}>|&([a-z]{{2,8}}|#[0-9]{{1,6}});', ' ', 'g')), '[^\p{{L}}\p{{N}}]'), lambda w: w <> '')"
_CHARS = rf"regexp_replace({{}}, '[^一-鿿㐀-䶿]', '', 'g')"

_LEAKS = rf"""WITH {_TRAIN}, q AS (SELECT item_id, question, 2 * length({_CHARS.format('question')}) > length(regexp_replace(question, '[^\p{{L}}]', '', 'g')) AS zh FROM eval_item),
iw AS (SELECT item_id, {_WORDS.format('question')} AS w FROM q WHERE NOT zh), ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw)),
ic AS (SELECT item_id, {_CHARS.format('question')} AS c FROM q WHERE zh), ih AS (SELECT DISTINCT item_id, c[i:i + 19] AS g FROM (SELECT item_id, c, unnest(range(1, length(c) - 18)) AS i FROM ic)),
xw AS (SELECT tbl, id, {_WORDS.format('text')} AS w FROM x), xg AS (SELECT tbl, id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT tbl, id, w, unnest(range(1, len(w) - 10)) AS i FROM xw)),
xc AS (SELECT tbl, id, {_CHARS.format('text')} AS c FROM x), xh AS (SELECT tbl, id, c[i:i + 19] AS g FROM (SELECT tbl, id, c, unnest(range(1, length(c) - 18)) AS i FROM xc))
SELECT DISTINCT tbl, id AS record_id, item_id FROM xg JOIN ig USING (g) UNION SELECT DISTINCT tbl, id, item_id FROM xh JOIN ih USING (g)"""

ORACLE = {
    "p2_found": f"WITH {_SETS} SELECT a.tbl, a.id AS id_a, b.id AS id_b FROM w a JOIN w b ON a.tbl = b.tbl AND a.word = b.word AND a.id < b.id GROUP BY ALL HAVING 17 * count(*) >= 7 * (any_value(a.n) + any_value(b.n))",
    "p2_groups": f"""WITH RECURSIVE {_SETS}, l AS (SELECT a.tbl, a.id AS x, b.id AS y FROM w a JOIN w b ON a.tbl = b.tbl AND a.word = b.word AND a.id <> b.id GROUP BY ALL HAVING 17 * count(*) >= 7 * (any_value(a.n) + any_value(b.n))),
g AS (SELECT DISTINCT tbl, id, id AS reached FROM w UNION SELECT g.tbl, g.id, l.y FROM g JOIN l ON g.tbl = l.tbl AND g.reached = l.x) SELECT tbl, id, min(reached) AS group_id FROM g GROUP BY 1, 2""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_found": _LEAKS,
    "p6_items": "SELECT item_id, " + ", ".join(f"count(*) FILTER (WHERE tbl = '{t}') AS n_{t}" for t in ("mcq", "verifiable", "sft", "documents")) + f" FROM ({_LEAKS}) GROUP BY item_id",
}
