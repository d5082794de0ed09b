"""Streams give what the batch gives; late and repeated rows are told apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom import streaming


def test_new_records_and_monitor(spark, tmp_path):
    d = str(tmp_path / "in")
    rows = [(i % 7, f"2025-01-0{1 + i % 7}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, at string, v double").withColumn("at", F.col("at").cast("timestamp"))
    df.repartition(3).write.parquet(d)
    s = streaming.file_stream(spark, d, df.schema, per_trigger=1)
    assert sorted(r.k for r in streaming.run_once(streaming.new_records(s, "k", "at")).collect()) == list(range(7))
    seen = []
    q = streaming.rolling_monitor(streaming.file_stream(spark, d, df.schema), "v", "v", ["k"], lambda b, _: seen.extend(b.collect()), n=2)
    q.awaitTermination()
    assert len(seen) == 40 and {r.v: r.trailing_mean for r in seen}[8.0] == 4.5
    # over two batches, the second goes on from the first
    seen.clear()
    q = streaming.rolling_monitor(streaming.file_stream(spark, d, df.schema, per_trigger=1), "v", "v", ["k"], lambda b, e: seen.extend((e, r) for r in b.collect()), n=3)
    q.awaitTermination()
    assert len({e for e, _ in seen}) == 3
    for k in range(7):
        values = [(e, r.v, r.trailing_mean) for e, r in sorted(seen, key=lambda x: (x[0], x[1].v)) if r.k == k]
        assert all(abs(m - sum(x[1] for x in values[max(0, i - 2) : i + 1]) / min(3, i + 1)) < 1e-9 for i, (_, _, m) in enumerate(values))
    w = streaming.run_once(streaming.windowed(s, "at", ["k"], "v"), "complete")
    assert w.agg(F.sum("n")).first()[0] == 40


def test_states_of_many_rounds(spark, tmp_path):
    """All rounds of all attempts count, however many, late or repeated."""
    d = str(tmp_path / "events")
    rows = [(1, a, r, a * 100 + r, "verify", (a, r) == (1, 80)) for a in range(2) for r in range(81)] + [(1, 0, 3, 3, "verify", False), (2, 0, 0, 900, "verify", True), (2, 0, 5, 901, "init", None)]
    df = spark.createDataFrame(rows, "process_id long, attempt int, round int, event_id long, kind string, verdict boolean")
    df.repartition(4).write.parquet(d)
    s = streaming.file_stream(spark, d, df.schema, per_trigger=1)
    out = streaming.run_once(streaming.fold_states(s), "update").groupBy("process_id").agg(F.max_by("rounds", "version"), F.max_by("solved", "version"))
    assert sorted(map(tuple, out.collect())) == [(1, 162, True), (2, 1, True)]
