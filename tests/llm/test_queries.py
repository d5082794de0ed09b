"""Every query of the subpackage runs on the smallest tables; those with SQL give the same rows."""

from __future__ import annotations

import pytest

from tests.oracle import compare
from veriloom.llm import queries


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], sf) is None


COLUMNS = {
    "p1_found": "sft_id bigint, field string, lang string", "p2_found": "tbl string, id_a bigint, id_b bigint", "p3_found": "sft_id bigint, field string, defect string",
    "p5_found": "tbl string, record_id bigint", "p6_found": "tbl string, record_id bigint, item_id bigint", "p7_ids": "doc_id bigint, ids array<int>",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    assert ", ".join(f"{c} {t}" for c, t in queries.QUERIES[name](spark, sf).dtypes) == COLUMNS[name]
