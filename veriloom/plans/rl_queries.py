"""Queries on recorded rollouts (the embeddings stand for logits and values, events for metrics); with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import arrays as A
from veriloom.functions import text as X
from veriloom.operators import extensions, relational, rl
from veriloom.plans.answer_queries import PRED, _predictions
from veriloom.sources import completion
from veriloom.sources.tables import load

GAMMA, LAM, KL_COEF = 1.0, 0.95, 0.05


def _rollouts(spark: SparkSession, d: str) -> DataFrame:
    """(seq_id, label, logits, logprobs, ref, values, kls, last, score): log-probabilities from the embedding, the reference from the next one."""
    e = load(spark, d, "embeddings", "vec_id", "embedding", "label").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    neg = lambda c: F.transform(c, lambda v: -F.abs(v))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), neg("x").alias("ref"))
    r = e.join(nxt, "vec_id").select(F.col("vec_id").alias("seq_id"), "label", F.col("x").alias("logits"), neg("x").alias("logprobs"), "ref", F.transform("x", lambda v: v / 2).alias("values"))
    r = r.withColumn("kls", A.kl(F.col("logprobs"), F.col("ref"))).withColumn("last", (F.col("seq_id") % 60 + 2).cast("int"))
    return r.withColumn("score", F.when(F.col("label") > 4, 1.0).otherwise(0.1))


def _with_rewards(spark: SparkSession, d: str) -> DataFrame:
    return _rollouts(spark, d).withColumn("rewards", A.rewards(F.col("kls"), F.col("score"), F.col("last"), KL_COEF))


def logprobs(spark: SparkSession, d: str) -> DataFrame:
    r = _rollouts(spark, d)
    z = A.scaled(F.col("logits"), 0.5)
    return r.select("seq_id", F.round(A.log_prob(z, F.col("label")), 6).alias("logp"), F.round(A.entropy(z), 6).alias("entropy"), A.argmax(F.col("logits")).cast("long").alias("top"), F.round(A.total(F.col("kls")), 6).alias("kl"))


def masked_logprobs(spark: SparkSession, d: str) -> DataFrame:
    m = A.mask_after(F.col("logprobs"), F.col("last"), A.INVALID_LOGPROB)
    v = A.mask_after(F.col("values"), F.col("last") + 1, 0.0)
    return _rollouts(spark, d).select("seq_id", F.round(A.total(m), 6).alias("logp"), F.round(A.total(v), 6).alias("value"))


def reward_placement(spark: SparkSession, d: str) -> DataFrame:
    r = _with_rewards(spark, d)
    return r.select("seq_id", F.round(A.total(F.col("rewards")), 6).alias("total"), F.round(F.element_at("rewards", F.least(F.col("last") + 2, F.lit(64))), 6).alias("at_end"))


def gae(spark: SparkSession, d: str) -> DataFrame:
    r = _with_rewards(spark, d).withColumn("adv", rl.advantage(F.col("rewards"), F.col("values"), GAMMA, LAM))
    return r.select("seq_id", F.posexplode(F.zip_with("adv", "values", lambda a, v: F.struct(a.alias("a"), (a + v).alias("r")))).alias("t", "p")).select("seq_id", "t", F.round("p.a", 6).alias("advantage"), F.round("p.r", 6).alias("ret"))


def gae_folded(spark: SparkSession, d: str) -> DataFrame:
    r = _with_rewards(spark, d).withColumn("adv", A.gae(F.col("rewards"), F.col("values"), GAMMA, LAM))
    return r.select("seq_id", F.posexplode("adv").alias("t", "a")).select("seq_id", "t", F.round("a", 6).alias("advantage"))


def whitened(spark: SparkSession, d: str) -> DataFrame:
    r = _rollouts(spark, d).withColumn("batch", (F.col("seq_id") % 8).cast("int"))
    w = rl.whiten(r, "values", F.transform("values", lambda v, i: i <= F.col("last")), "batch")
    return w.select("seq_id", F.round(F.get("values", F.lit(0)), 6).alias("first"), F.round(A.total(F.col("values")), 6).alias("total"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    r = _with_rewards(spark, d)
    z = F.arrays_zip(F.col("logprobs").alias("n"), F.col("ref").alias("o"), F.col("values").alias("v"), F.col("rewards").alias("r"))
    p = r.select("seq_id", "last", F.posexplode(z).alias("t", "p"))
    c = {"adv": F.col("p.r"), "new_logp": F.col("p.n"), "old_logp": F.col("p.o"), "vpred": F.col("p.v"), "old_value": F.col("p.v") + F.col("p.o") / 4, "ret": F.col("p.r") + F.col("p.v") / 3}
    return p.withColumns(c | {"mask": F.col("t") <= F.col("last"), "mask_p1": F.col("t") <= F.col("last") + 1, "minibatch": F.col("seq_id") % 4}).drop("p")


def ppo_losses(spark: SparkSession, d: str) -> DataFrame:
    out = rl.losses(_long(spark, d), ["minibatch"])
    return out.select("minibatch", *[F.round(c, 6).alias(c) for c in ("pg_loss", "pg_clipfrac", "vf_loss", "vf_clipfrac", "approxkl", "ratio", "loss")])


def objective(spark: SparkSession, d: str) -> DataFrame:
    r = _rollouts(spark, d).withColumn("rank", (F.col("seq_id") % 8).cast("int"))
    out = rl.objective(r, "kls", "logprobs", "score", ["rank"], KL_COEF)
    return out.select("rank", *[F.round(c, 6).alias(c) for c in ("kl", "entropy", "non_score_reward", "rlhf_reward", "scores")])


def reward_rule(spark: SparkSession, d: str) -> DataFrame:
    df = _predictions(spark, d, "output").filter(F.col("output").isNotNull())
    z = rl.scored(F.col("prediction_id").cast("string"), rl.StubScorer())
    p = A.two_class(F.lit(0.0), z)
    form = X.has_answer_format(F.col("output"))
    return df.select("prediction_id", form.alias("well_formed"), A.rule_reward(form, p).alias("reward"), F.md5(X.final_section(F.col("output"))).alias("section"))


def rolling_reward(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "ts", "user_id", "value").withColumn("rank", F.col("user_id") % 8)
    return rl.trailing_mean(e, "value", ["ts", "event_id"], ["rank"]).select("event_id", F.round("trailing_mean", 6).alias("trailing_mean"))


def metric_means(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_type", "user_id", "value").withColumn("rank", F.col("user_id") % 8)
    out = rl.mean_of_means(e, "value", "rank", ["event_type"])
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def checkpoint_retention(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderkey")
    return relational.retained(o, "o_custkey", "o_orderdate", 3).filter("keep").select("o_custkey", "o_orderkey")


def failure_share(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "search_event", "event_id", "kind", "valid").distinct().withColumn("error", F.when(~F.col("valid"), "invalid"))
    return completion.failure_share(e, "kind").withColumn("failed", F.round("failed", 6))


def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    return rl.cosine_schedule(spark, 1000, 0.05, 5e-6).select("step", F.round(F.col("lr") * 1e6, 6).alias("lr"))


def sampled_metrics(spark: SparkSession, d: str) -> DataFrame:
    return relational.every(load(spark, d, "events", "event_id", "value"), "event_id", 3).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def kl_coefficient(spark: SparkSession, d: str) -> DataFrame:
    k = F.transform("kls", lambda x: F.abs(x))
    return _rollouts(spark, d).select("seq_id", F.round(extensions.adaptive_coefficient(k, 0.05, 0.1, 100.0), 6).alias("coef"))


def shaped_rewards(spark: SparkSession, d: str) -> DataFrame:
    df = _predictions(spark, d, "output").filter(F.length("output") > 0)
    n = F.length("output")
    pen = extensions.overlong_penalty(n, 600, 1000)
    comp = extensions.composite_reward(F.lit(1.0), n / 1000, X.has_answer_format(F.col("output")).cast("double"), F.lit(0.5), -pen)
    return df.select("prediction_id", F.round(pen, 6).alias("penalty"), F.round(comp, 6).alias("reward"), F.round(extensions.asymmetric_clip(n / 500), 6).alias("clipped"))


QUERIES = {
    f.__name__: f
    for f in (logprobs, masked_logprobs, reward_placement, gae, gae_folded, whitened, ppo_losses, objective, reward_rule, rolling_reward, metric_means, checkpoint_retention, failure_share, learning_rates, sampled_metrics, kl_coefficient, shaped_rewards)
}

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
_R = f"""{_E}, roll AS (SELECT a.vec_id AS seq_id, a.label, a.x AS logits, list_transform(a.x, lambda v: -abs(v)) AS lp, list_transform(b.x, lambda v: -abs(v)) AS rf, (a.vec_id % 60 + 2)::INT AS lst,
CASE WHEN a.label > 4 THEN 1.0 ELSE 0.1 END::DOUBLE AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"""
_LONG = f"""{_R}, t AS (SELECT seq_id, label, lst, score, i - 1 AS t, logits[i] / 2 AS v, lp[i] AS lp, rf[i] AS rf, lp[i] - rf[i] AS kl, len(lp) AS n FROM roll, range(1, 65) AS q(i)),
w AS (SELECT *, -0.05 * kl + CASE WHEN t = CASE WHEN lst + 1 < n THEN lst + 1 ELSE lst END THEN score ELSE 0 END AS r FROM t)"""
_ADV = f"""{_LONG}, dl AS (SELECT *, r + coalesce(lead(v) OVER (PARTITION BY seq_id ORDER BY t), 0) - v AS dlt FROM w),
adv AS (SELECT a.seq_id, a.t, any_value(a.v) AS v, sum(b.dlt * power(0.95, b.t - a.t)) AS a FROM dl a JOIN dl b ON a.seq_id = b.seq_id AND b.t >= a.t GROUP BY 1, 2)"""

ORACLE = {
    "logprobs": f"""WITH {_R}, z AS (SELECT *, list_transform(logits, lambda v: v / (0.5 + 1e-7)) AS z FROM roll), m AS (SELECT *, ln(list_sum(list_transform(z, lambda v: exp(v)))) AS m FROM z)
SELECT seq_id, round(z[(label + 1)::INT] - m, 6) AS logp, round(m - list_sum(list_transform(z, lambda v: exp(v - m) * v)), 6) AS entropy, (list_position(logits, list_max(logits)) - 1)::BIGINT AS top,
round(list_sum(lp) - list_sum(rf), 6) AS kl FROM m""",
    "masked_logprobs": f"WITH {_LONG} SELECT seq_id, round(sum(CASE WHEN t > lst THEN 1.0 ELSE lp END), 6) AS logp, round(sum(CASE WHEN t > lst + 1 THEN 0 ELSE v END), 6) AS value FROM w GROUP BY 1",
    "reward_placement": f"WITH {_LONG} SELECT seq_id, round(sum(r), 6) AS total, round(max(CASE WHEN t = least(lst + 1, 63) THEN r END), 6) AS at_end FROM w GROUP BY 1",
    "gae": f"WITH {_ADV} SELECT seq_id, t::INT AS t, round(a, 6) AS advantage, round(a + v, 6) AS ret FROM adv",
    "gae_folded": f"WITH {_ADV} SELECT seq_id, t::INT AS t, round(a, 6) AS advantage FROM adv",
    "whitened": f"""WITH {_LONG}, s AS (SELECT seq_id % 8 AS b, avg(v) AS m, var_samp(v) AS s FROM w WHERE t <= lst GROUP BY 1)
SELECT seq_id, round(max(CASE WHEN t = 0 THEN (v - m) / sqrt(s + 1e-8) END), 6) AS "first", round(sum((v - m) / sqrt(s + 1e-8)), 6) AS total FROM w JOIN s ON seq_id % 8 = b GROUP BY seq_id""",
    "ppo_losses": f"""WITH {_LONG}, x AS (SELECT seq_id % 4 AS minibatch, t <= lst AS m, t <= lst + 1 AS m1, r AS a, lp - rf AS d, exp(lp - rf) AS q, v, v + rf / 4 AS ov, r + v / 3 AS rt FROM w),
y AS (SELECT *, -a * q AS p1, -a * greatest(0.8, least(1.2, q)) AS p2, power(v - rt, 2) AS f1, power(greatest(ov - 0.2, least(ov + 0.2, v)) - rt, 2) AS f2 FROM x),
g AS (SELECT minibatch, avg(greatest(p1, p2)) FILTER (m) AS pg_loss, avg((p2 > p1)::INT) FILTER (m) AS pg_clipfrac, 0.5 * avg(greatest(f1, f2)) FILTER (m1) AS vf_loss, avg((f2 > f1)::INT) FILTER (m1) AS vf_clipfrac, 0.5 * avg(d * d) AS approxkl, avg(q) AS ratio FROM y GROUP BY 1)
SELECT minibatch, round(pg_loss, 6) AS pg_loss, round(pg_clipfrac, 6) AS pg_clipfrac, round(vf_loss, 6) AS vf_loss, round(vf_clipfrac, 6) AS vf_clipfrac, round(approxkl, 6) AS approxkl, round(ratio, 6) AS ratio, round(pg_loss + 0.1 * vf_loss, 6) AS loss FROM g""",
    "objective": f"""WITH {_R}, s AS (SELECT (seq_id % 8)::INT AS rank, list_sum(lp) - list_sum(rf) AS kl, -list_sum(lp) AS en, score FROM roll)
SELECT rank, round(avg(kl), 6) AS kl, round(avg(en), 6) AS entropy, round(-0.05 * avg(kl), 6) AS non_score_reward, round(-0.05 * avg(kl) + avg(score), 6) AS rlhf_reward, round(avg(score), 6) AS scores FROM s GROUP BY 1""",
    "reward_rule": rf"""WITH {PRED}, c AS (SELECT prediction_id, output, (length(output) - length(replace(output, '## Final Response' || chr(10) || chr(10), ''))) / 19 = 1 AND (length(output) - length(replace(output, '## Thinking', ''))) / 11 = 1 AS f,
('0x' || substr(md5(prediction_id::VARCHAR), 1, 8))::BIGINT % 1000 / 500.0 - 1 AS z FROM p WHERE output IS NOT NULL)
SELECT prediction_id, f AS well_formed, CASE WHEN NOT f THEN 0.0 WHEN 1 / (1 + exp(-z)) > 0.4 THEN 1.0 ELSE 0.1 END::DOUBLE AS reward,
md5(regexp_replace(regexp_extract(output, '(?s)## Final Response\n\n(.*)', 1), '^\s+|\s+$', '', 'g')) AS section FROM c""",
    "rolling_reward": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM events",
    "metric_means": "WITH r AS (SELECT event_type, user_id % 8 AS k, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, round(avg(m), 6) AS mean, round(var_samp(m), 6) AS variance FROM r GROUP BY 1",
    "checkpoint_retention": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3",
    "failure_share": "WITH e AS (SELECT DISTINCT event_id, kind, valid FROM search_event) SELECT kind, count(*) AS n, round(avg((NOT valid)::INT), 6) AS failed FROM e GROUP BY 1",
    "learning_rates": "SELECT i AS step, round(1e6 * CASE WHEN i < 50 THEN 5e-6 * i / 50 ELSE 5e-6 * greatest(0, 0.5 * (1 + cos(pi() * (i - 50) / 950.0))) END, 6) AS lr FROM range(1000) AS q(i)",
    "sampled_metrics": "SELECT count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_id % 3 = 0",
    "kl_coefficient": f"WITH {_R} SELECT seq_id, round(list_reduce(list_transform(range(1, 65), lambda i: 1 + greatest(-0.2, least(0.2, abs(lp[i] - rf[i]) / 0.1 - 1)) / 100), lambda a, b: a * b) * 0.05, 6) AS coef FROM roll",
    "shaped_rewards": f"""WITH {PRED}, n AS (SELECT prediction_id, length(output) AS n, ((length(output) - length(replace(output, '## Final Response' || chr(10) || chr(10), ''))) / 19 = 1 AND (length(output) - length(replace(output, '## Thinking', ''))) / 11 = 1)::INT AS f FROM p WHERE length(output) > 0),
q AS (SELECT *, -greatest(0, least(1, (n - 600) / 400.0)) AS pen FROM n) SELECT prediction_id, round(pen, 6)::DOUBLE AS penalty, round(0.45 + 0.25 * n / 1000 + 0.2 * f + 0.05 + pen, 6)::DOUBLE AS reward, round(greatest(0.8, least(1.28, n / 500.0)), 6)::DOUBLE AS clipped FROM q""",
}
