"""Plain relational and streaming queries on the star-schema tables. Not part of the record pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom import streaming
from veriloom.operators import timeseries
from veriloom.sources.tables import load


def rel_revenue(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    # prices are summed by supplier before anything is joined
    per = li.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    s = per.join(load(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = load(spark, d, "nation", "n_nationkey", "n_name")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


def rel_rollup(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().cast("long").alias("level"))


def rel_semi(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer", "c_custkey", "c_mktsegment")
    o = load(spark, d, "orders", "o_custkey", "o_totalprice").filter("o_totalprice > 100000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def rel_rank(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part", "p_partkey", "p_brand", "p_retailprice")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("p_brand", "p_partkey", F.col("k").cast("long").alias("k"))


def rel_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return timeseries.as_of(left, e.filter("event_type <> 'purchase'"), ["user_id"], "ts", "value").select("event_id", "value")


def rel_range_join(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")
    s = load(spark, d, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", (F.col("s_suppkey") % 50 + 1).cast("int").alias("p_size"), (900 + F.col("s_suppkey") % 900).cast("double").alias("lo"), (950 + F.col("s_suppkey") % 900).cast("double").alias("hi"))
    return timeseries.range_join(p, s, ["p_size"], "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "s_suppkey")


def rel_sessions(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.sessions(load(spark, d, "events", "user_id", "ts"), ["user_id"], "ts", 1800).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def rel_sets(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "customer", F.col("c_nationkey").alias("k")).intersect(load(spark, d, "supplier", F.col("s_nationkey").alias("k")))
    return a.union(load(spark, d, "nation", F.col("n_nationkey").alias("k")).exceptAll(a)).groupBy("k").agg(F.count("*").alias("n"))


def _glob(d: str, table: str) -> str:
    return f"{d}/{table}.parquet*"


def stream_new_records(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/prediction.parquet").schema
    s = streaming.file_stream(spark, _glob(d, "prediction"), schema).select("prediction_id", "model", "arrived_at")
    return streaming.run_once(streaming.new_records(s, "prediction_id", "arrived_at", "3650 days")).select("prediction_id", "model")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = streaming.file_stream(spark, _glob(d, "events"), schema).select("ts", "event_type", "value")
    out = streaming.run_once(streaming.windowed(s, "ts", ["event_type"], "value", "1 day"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_states(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/search_event.parquet").schema
    s = streaming.file_stream(spark, _glob(d, "search_event"), schema).select("process_id", "attempt", "round", "kind", "event_id", F.col("verdict").cast("boolean").alias("verdict"))
    out = streaming.run_once(streaming.fold_states(s.filter("kind = 'verify'")), "update")
    # a record's later states replace its earlier ones
    return out.groupBy("process_id").agg(F.max("rounds").cast("long").alias("rounds"), F.max_by("solved", "version").alias("solved"))


QUERIES = {f.__name__: f for f in (rel_revenue, rel_rollup, rel_semi, rel_rank, rel_as_of, rel_range_join, rel_sessions, rel_sets, stream_new_records, stream_windows, stream_states)}

ORACLE = {
    "rel_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "rel_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rel_semi": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) GROUP BY 1",
    "rel_rank": "SELECT p_brand, p_partkey, k FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3",
    "rel_as_of": "WITH r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2) SELECT event_id, r.value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "rel_range_join": "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size = s_suppkey % 50 + 1 AND p_retailprice >= 900 + s_suppkey % 900 AND p_retailprice < 950 + s_suppkey % 900",
    "rel_sessions": """WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w >= INTERVAL 1800 SECOND)::INT, 1) AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "rel_sets": "WITH a AS (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier), u AS (SELECT k FROM a UNION ALL (SELECT n_nationkey FROM nation EXCEPT ALL SELECT k FROM a)) SELECT k, count(*) AS n FROM u GROUP BY 1",
    "stream_new_records": "SELECT DISTINCT prediction_id, model FROM prediction",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_states": "SELECT process_id, count(DISTINCT (attempt, round)) AS rounds, coalesce(arg_max(verdict::BOOLEAN, (attempt, round, event_id)), false) AS solved FROM search_event WHERE kind = 'verify' GROUP BY 1",
}
