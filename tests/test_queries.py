"""Every query of the core runs on the smallest tables; those with SQL give the same rows."""

from __future__ import annotations

import pytest

from tests.oracle import compare
from veriloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, sf, name):
    assert compare(spark, name, registry.QUERIES[name], registry.ORACLE[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["source", "score", "head_hits", "total", "tail_hits"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_anti_join_is_broadcast(spark, sf):
    df = registry.QUERIES["resume_anti_join"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan


def test_one_shuffle_to_score(spark):
    from veriloom.operators import answers

    df = spark.createDataFrame([("s", "The answer is A", [("A", "x")], "A")], "source string, output string, options array<struct<label:string,text:string>>, answer_idx string")
    plan = answers.score(answers.extract(df, fuzzy=False))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
