"""Structural-variant tables against a recursive version, and odd shapes."""

from __future__ import annotations

import json
import random

from veriloom.operators.variants import Field, Kind, Layout, nodes, subtype_tables, transitions, variant_nodes, variant_tables
from veriloom.sources.tables import latest_delivery


def steps_of(state, path=""):
    """Steps by plain recursion: (path, round, step)."""
    rounds = state.get("response_struct")
    for i, r in enumerate(rounds if isinstance(rounds, list) else [rounds] if isinstance(rounds, dict) else []):
        body = r.get("CoT") if isinstance(r, dict) and "CoT" in r else r if not isinstance(r, dict) or set(r) & {"action", "title", "content"} else None
        body = json.loads(body) if isinstance(body, str) else body
        for j, s in enumerate(body if isinstance(body, list) else [body] if isinstance(body, dict) else []):
            if s is not None:
                yield path, i, j
    prior = state.get("prior_fail_try")
    for k, p in enumerate(prior if isinstance(prior, list) else []):
        if isinstance(p, dict):
            yield from steps_of(p, f"{path}/{k}")


def make(rng, depth=0):
    step = lambda: rng.choice([{"action": "a", "title": None, "content": "c"}, {"content": "x"}, {}, None, {"action": "a", "refs": [{"kind": "k"}, None]}])
    rounds = []
    for _ in range(rng.randint(0, 3)):
        lst = [step() for _ in range(rng.randint(0, 4))]
        rounds.append(rng.choice([{"CoT": lst}, lst, {"CoT": json.dumps(lst)}, {"CoT": {"action": "a"}}, {"CoT": None}, {}, None, {"content": "lone"}]))
    out = {"verify": [True], "response_struct": rng.choice([rounds, rounds, None, {"CoT": [{}]}])}
    if depth < 4 and rng.random() < 0.6:
        out["prior_fail_try"] = rng.choice([[make(rng, depth + 1) for _ in range(rng.randint(1, 2))], None, [], [None, make(rng, depth + 1)]])
    if rng.random() < 0.2:
        del out["response_struct"]
    return out


def test_random_records(spark):
    rng = random.Random(3)
    made = [make(rng) for _ in range(400)]
    rows = [(i, json.dumps(m), "clash", i) for i, m in enumerate(made)]
    df = spark.createDataFrame(rows, "record_id long, raw string, node string, k long")
    t = variant_tables(variant_nodes(df))
    got = sorted((r.record_id, r.state_path, r.round_no, r.step_no) for r in t["steps"].collect())
    assert got == sorted((i, *s) for i, m in enumerate(made) for s in steps_of(m))
    states = {(r.record_id, r.state_path): r.parent_path for r in t["states"].collect()}
    assert all(p is None if not path else (i, p) in states for (i, path), p in states.items())
    rounds = {(r.record_id, r.state_path, r.round_no) for r in t["rounds"].collect()}
    assert {g[:3] for g in got} <= rounds
    assert {(r.record_id, r.state_path, r.round_no, r.step_no) for r in t["refs"].collect()} <= set(got)


def test_odd_texts(spark):
    deep = '{"prior_fail_try": [' * 300 + "{}" + "]}" * 300
    rows = [(1, None), (2, ""), (3, "{"), (4, "[]"), (5, '{"response_struct": [{"CoT": [{}]}]} x'), (6, "NaN"), (None, '{"response_struct": [{"CoT": [{}]}]}'), (7, deep), (8, '{"process_id": 1e400}'), (8, '{"process_id": true}')]
    df = spark.createDataFrame(rows, "record_id long, raw string")
    t = variant_tables(variant_nodes(df))
    assert [(r.record_id, r.state_path) for r in t["steps"].collect()] == [(None, "")]
    assert t["states"].filter("record_id = 7").count() == 301
    assert t["states"].filter("record_id = 8").count() == 2
    assert variant_nodes(df.limit(0)).count() == 0


def test_long_text():
    raw = json.dumps({"response_struct": [{"CoT": [{"content": "x" * 3_000_000}] * 2}]})
    assert sum(n[1] == "step" for n in nodes(1, raw)) == 2


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (None, "c", 1), (None, "d", 0)], "k long, v string, arrived_at int")
    assert sorted((r.k or 0, r.v) for r in latest_delivery(df, "k").collect()) == [(0, "c"), (1, "b")]


def test_nothing_is_dropped(spark):
    """Other keys of a round, a lone reference, and values in place of lists are kept."""
    raw = {"response_struct": [{"CoT": [{"content": "a", "refs": {"kind": "k", "more": 1}}, {"refs": "see above"}, 7], "note": "n"}, "plain", {"CoT": "told"}], "prior_fail_try": "none"}
    t = variant_tables(variant_nodes(spark.createDataFrame([(1, json.dumps(raw)), (2, '{"response_struct": "later"}')], "record_id long, raw string")))
    assert [json.loads(r.extra) for r in t["states"].orderBy("record_id").collect()] == [{"prior_fail_try": "none"}, {"response_struct": "later"}]
    assert [r.extra for r in t["rounds"].orderBy("round_no").collect()] == ['{"note": "n"}', "plain", '{"CoT": "told"}']
    assert [(r.content, r.extra) for r in t["steps"].orderBy("step_no").collect()] == [("a", None), (None, '{"refs": "see above"}'), ("7", None)]
    assert [(r.step_no, r.ref_no, r.ref_kind, r.extra) for r in t["refs"].collect()] == [(0, 0, "k", '{"more": 1}')]


def test_states_depend_on_what_is_below(spark):
    rows = [(1, {"response_struct": [{"CoT": [{"content": "a"}]}]}), (2, {"response_struct": [{"CoT": [{"action": "a"}]}]}), (3, {"response_struct": [{"CoT": [{"content": "b"}]}] * 3}), (4, {"prior_fail_try": [{"response_struct": [{"CoT": [{"content": "a"}]}]}]}), (5, {"prior_fail_try": [{"response_struct": None}]})]
    n = variant_nodes(spark.createDataFrame([(i, json.dumps(r)) for i, r in rows], "record_id long, raw string"))
    v = {r.record_id: r.variant for r in n.filter("node = 'state' AND state_path = ''").collect()}
    assert v[1] == v[3] and len(set(v.values())) == 4
    # nesting without end has finitely many variants
    deep = {}
    for _ in range(60):
        deep = {"response_struct": [], "prior_fail_try": [deep]}
    n = variant_nodes(spark.createDataFrame([(1, json.dumps(deep))], "record_id long, raw string"))
    assert n.count() == 61 and transitions(n).count() <= 3


def test_typed_tables(spark):
    rows = [(1, {"response_struct": [{"CoT": [{"action": "a", "content": "c"}, {"title": "t", "content": None}, 5]}]})]
    n = variant_nodes(spark.createDataFrame([(i, json.dumps(r)) for i, r in rows], "record_id long, raw string"))
    found = [(r.node, r.variant) for r in transitions(n).collect()]
    steps = {v: t.columns[4:] for (k, v), t in subtype_tables(n, found).items() if k == "step"}
    assert steps == {"step:{action,content}": ["action", "content"], "step:{title,content?}": ["title", "content"], "step:number": ["content", "extra"]}
    assert sum(t.count() for t in subtype_tables(n, found).values()) == n.count()


def test_another_layout(spark):
    """A new layout needs no code: orders with lines and notes, and orders inside orders."""
    shop = Layout(
        "order",
        {"order": Kind(None, (Field("id", "order_id", "long"),), (("lines", "line"), ("parts", "order"))), "line": Kind("line_no", (Field("sku", "sku"), Field("qty", "qty", "long")), (("notes", "note"),)), "note": Kind("note_no", (), (), "value")},
        key="doc", path="order_path",
    )
    raw = {"id": 7, "lines": [{"sku": "x", "qty": 2, "notes": ["n", None, "m"]}, None, {"sku": 1}], "parts": [{"id": 8, "lines": {"sku": "y", "colour": "red"}}]}
    t = variant_tables(variant_nodes(spark.createDataFrame([(1, json.dumps(raw))], "doc long, raw string"), "doc", "raw", shop), shop)
    assert [(r.order_path, r.parent_path, r.order_id) for r in t["orders"].orderBy("order_path").collect()] == [("", None, 7), ("/0", "", 8)]
    assert [(r.order_path, r.line_no, r.sku, r.qty, r.extra) for r in t["lines"].orderBy("order_path", "line_no").collect()] == [("", 0, "x", 2, None), ("", 2, "1", None, None), ("/0", 0, "y", None, '{"colour": "red"}')]
    assert [(r.line_no, r.note_no, r.extra) for r in t["notes"].orderBy("note_no").collect()] == [(0, 0, "n"), (0, 2, "m")]
