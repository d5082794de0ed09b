"""Pipelines with scripted completers, JSON validation, sources, ids and splits."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from veriloom.functions import arrays as A
from veriloom.functions import jsonx
from veriloom.functions import text as X
from veriloom.operators import extensions, relational, rl, sft
from veriloom.plans.curate import curate, finished
from veriloom.plans.search import SearchConfig, merged, search
from veriloom.sources import json_files
from veriloom.sources.completion import HttpCompleter, StubCompleter, complete, failure_share

STEPS = json.dumps({"CoT": [{"action": a, "content": a} for a in ("Inner Thinking", "Final Conclusion", "Verification")]})


class Script:
    """Verdicts by the number of steps told so far; everything else is valid."""

    def __init__(self, verdicts: str, init: str = STEPS, rewrite: str = '{"NaturalReasoning": "a\\nb"}'):
        self.verdicts, self.init, self.rewrite = verdicts, init, rewrite

    def one(self, p: str) -> str:
        if p.startswith("Does the conclusion"):
            n = int(p.split("Conclusion: c")[1].split("\n")[0])
            return "True" if self.verdicts[min(n, len(self.verdicts) - 1)] == "T" else "untold"
        if p.startswith("Tell this"):
            return self.rewrite
        if p.startswith("Answer the question from"):
            return "said"
        if p.startswith("Answer the question step"):
            return self.init.replace('"content": "Final Conclusion"', '"content": "c0"')
        n = p.count('"Final Conclusion"') - 1  # those told so far; the shape of the reply has one more
        return STEPS.replace('"content": "Final Conclusion"', f'"content": "c{n}"')

    def complete(self, prompts):
        return [self.one(p) for p in prompts]


@pytest.mark.parametrize(
    ("attempts", "depth", "verdicts", "efficient", "calls", "types", "solved"),
    [(1, 2, "T", True, 4, 1, True), (1, 2, "FT", True, 6, 2, True), (1, 2, "FFT", True, 8, 3, True), (1, 2, "FFF", True, 9, 4, True), (1, 2, "FFF", False, 6, 3, False)],
)
def test_search(spark, attempts, depth, verdicts, efficient, calls, types, solved):
    df = spark.createDataFrame([(1, "q", "g"), (2, None, "g")], "process_id long, open_question string, gold_answer string")
    out = search(df, Script(verdicts), SearchConfig(attempts, depth, efficient)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.calls, len(r.response_type), r.complex_cot is not None) == (calls, types, solved)
    if solved:
        assert (r.complex_cot, r.response, r.question) == ("a\nb", "said", "q")


def test_search_invalid(spark):
    df = spark.createDataFrame([(1, "q", "g")], "process_id long, open_question string, gold_answer string")
    assert search(df, Script("T", init="no json")).count() == 0
    lost = search(df, Script("T", rewrite='{"NaturalReasoning": "one line"}'))
    assert lost.count() == 1 and merged(lost).count() == 0


def test_curate_and_resume(spark):
    rows = [(i, f"q{i}", [("A", "x")], "x") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "process_id long, question string, options array<struct<label:string,text:string>>, answer string")
    good = '{"Open-ended Verifiable Question": "o", "Ground-True Answer": "a"}'
    stub = StubCompleter((("Is this item", ("does not pass", "Ambiguous Answer")),), (good,))
    out = curate(df, stub)
    assert out.count() == 8
    passed = out.filter("open_question is not null").count()
    assert passed == out.filter(X.passes(F.col("filter_response"))).count() and finished(out).count() == 8
    assert curate(df, stub, done=out.filter("process_id < 5").select("process_id")).count() == 4
    bad = curate(df, StubCompleter(default=("nothing",)), filter_first=False)
    assert bad.count() == 8 and finished(bad).count() == 0


@pytest.mark.parametrize(
    ("body", "ok"),
    [('{"CoT": [1]}', False), (STEPS, True), (STEPS + " tail", False), ("x " + STEPS + " y", True), (STEPS.replace('"', "'"), False), ("", False), (None, False), ('{"CoT": "x"}', False), ("[" * 50000, False)],
)
def test_steps_validation(spark, body, ok):
    df = spark.createDataFrame([(body,)], "r string")
    assert df.select(jsonx.parse_steps(F.col("r"))["ok"]).first()[0] is ok
    assert df.select(jsonx.parse_rewrite(F.col("r"))["ok"]).first()[0] is False


def test_json_files(spark, tmp_path):
    named = {"x": [{"q": "1", "options": {"B": "b", "A": "a"}}], "y": [{"q": "2", "options": {}}]}
    (tmp_path / "n.json").write_text(json.dumps(named))
    (tmp_path / "l.json").write_text(json.dumps([{"q": "3"}]))
    rows = json_files.read_named(spark, str(tmp_path / "*.json"), "q string, options map<string,string>")
    got = {(r.source, r.q) for r in rows.collect()}
    assert got == {("x", "1"), ("y", "2"), ("normal", "3")}
    first = rows.filter("q = '1'").select(json_files.option_entries(F.col("options")).alias("o")).first().o
    assert [(o.label, o.text) for o in first] == [("B", "b"), ("A", "a")]
    d = tmp_path / "records"
    d.mkdir()
    for i, x in enumerate(['{"a": "1"}', '{"b": "2"}', "broken", '{"a": "3", "b": "4"}']):
        (d / f"{i}.json").write_text(x)
    (d / "note.txt").write_text('{"a": "9"}')
    assert json_files.read_records(spark, str(d), "a string, b string", any_of=["a", "b"]).count() == 3
    assert json_files.read_records(spark, str(d), "a string, b string", all_of=["a", "b"]).count() == 1
    out = str(tmp_path / "out.json")
    assert json_files.export_array(rows.select("q"), out) == 3 and len(json.load(open(out))) == 3
    with pytest.raises(ValueError):
        json_files.export_array(rows.select("q"), out, most=2)
    stage = str(tmp_path / "stage")
    json_files.append_stage(spark.createDataFrame([(1, "old"), (2, "x")], "id long, v string"), stage)
    json_files.append_stage(spark.createDataFrame([(1, "new")], "id long, v string"), stage)
    assert {(r.id, r.v) for r in json_files.read_stage(spark, stage, "id").collect()} == {(1, "new"), (2, "x")}
    assert json_files.task_name("/a/b/demo.json") == "demo" and json_files.named_file("demo", "final", 3) == "demo_final_3.json"


def test_completion_errors(spark):
    class Broken:
        def complete(self, prompts):
            raise RuntimeError("down")

    df = complete(spark.createDataFrame([("a",), (None,)], "p string"), "p", Broken())
    assert [(r.response, r.error) for r in df.collect()] == [(None, "RuntimeError: down"), (None, None)]
    assert failure_share(df) == 0.5
    assert HttpCompleter("u", "m", extra={"temperature": 0.5}).body("x")["temperature"] == 0.5


def test_ids_split_batches(spark):
    df = spark.createDataFrame([(i * 7 % 101, f"t{i}") for i in range(101)], "k long, t string").repartition(5)
    ids = relational.assign_ids(df, ["k"]).collect()
    assert sorted((r.process_id, r.k) for r in ids) == [(i + 1, i) for i in range(101)]
    parts = relational.split(df, "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"eval": 10, "train": 91}
    b = relational.batches(spark.range(1, 12).withColumnRenamed("id", "n"), 4, "n", drop_last=True)
    assert b.groupBy("batch_id").count().count() == 2 and b.count() == 8
    assert relational.epochs(df, 3, "k").count() == 303
    r = relational.retained(spark.createDataFrame([(1, i, f"c{i}") for i in range(5)], "g long, at long, name string"), "g", "at", 2)
    assert {x.name for x in r.filter("keep").collect()} == {"c3", "c4"}


def test_arrays(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],)], "a array<int>")
    got = df.select(A.pad_right(F.col("a"), 4, 0), A.pad_left(F.col("a"), 2, 9), A.keep_last(F.col("a"), 2), A.mask_prompt(F.col("a"), F.lit(1)), A.first_index(F.col("a"), 7), A.cut_at_stop(F.col("a"), 6, 0)).collect()
    assert [list(r) for r in got] == [[[5, 6, 7, 0], [5, 6], [6, 7], [-100, 6, 7], 2, [5, 6, 0]], [[0] * 4, [9, 9], [], [], 0, []]]


def test_gae_golden(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], [0.5, 0.4, 0.3]), ([], []), (None, None)], "r array<double>, v array<double>")
    a = [r[0] for r in df.select(rl.advantage(F.col("r"), F.col("v"))).collect()]
    b = [r[0] for r in df.select(A.gae(F.col("r"), F.col("v"), 1.0, 0.95)).collect()]
    for got in (a, b):
        assert got[0] == pytest.approx([2.33925, 1.515, 1.7]) and got[1] == []
    assert a[2] is None


def test_reward_rule_and_placement(spark):
    r = spark.range(1).select(A.rule_reward(F.lit(False), F.lit(0.9)), A.rule_reward(F.lit(True), F.lit(0.41)), A.rule_reward(F.lit(True), F.lit(0.40)), A.rewards(F.array(F.lit(1.0), F.lit(2.0)), F.lit(5.0), F.lit(0), 0.0), A.rewards(F.array(F.lit(1.0), F.lit(2.0)), F.lit(5.0), F.lit(1), 0.0)).first()
    assert list(r) == [0.0, 1.0, 0.1, [0.0, 5.0], [0.0, 5.0]]
    assert rl.batch_sizes(20000, 1, 16, 1, 8)["updates"] == 157 and rl.interval(0.1, 57) == 6


def test_extensions(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.9), ("m", 1, 0.2), ("m", 0, 0.1)], "m string, l int, s double")
    r = extensions.binary_metrics(df, "l", "s", ["m"]).first()
    assert (r.n, r.accuracy, r.f1, r.auroc) == (4, 0.5, 0.5, 0.625)
    assert extensions.informative_groups(df, "m", "s").count() == 1
    assert extensions.candidates(df).count() == 16
    t = spark.createDataFrame([("a b c d a b c d",), ("a",), (None,)], "t string").select(extensions.repetition(F.col("t"))).collect()
    assert [x[0] for x in t] == [pytest.approx(0.2), 0.0, 0.0]
    names = spark.createDataFrame([("h.bias",), ("h.weight",)], "n string")
    assert [r.decays for r in sft.decay_groups(names, "n").collect()] == [False, True]
    assert extensions.hash_split(spark.range(1000), "id", {"train": 0.8, "dev": 0.1, "test": 0.1}).groupBy("split").count().count() == 3
    assert extensions.abnormal_length(spark.createDataFrame([("x" * i, "g") for i in range(1, 200)], "t string, g string"), "t", ["g"]).filter("abnormal").count() in range(1, 6)


def test_text_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 200_000,), ("  a 　",)], "t string")
    t = F.col("t")
    got = df.select(X.strip(t), X.bracket_content(t), X.count_of(t, "x"), X.final_section(t), X.postprocess(t)).collect()
    assert list(got[0]) == [None] * 5 and got[3][0] == "a" and got[2][2] == 200_000 and got[1][3] == ""
    assert spark.range(1).select(X.fill("{{{a}}} {b}", a=F.lit("{b}"), b=F.lit("x"))).first()[0] == "{{b}} x"


def test_release(spark):
    from veriloom import session

    df = session.materialise(spark.range(5), "kept")
    path = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert df.count() == 5 and os.path.isdir(path)
    assert session.release(spark) >= 1 and not os.path.isdir(path)


class Flaky:
    """Fails single prompts."""

    def complete(self, prompts):
        return [ValueError("no") if p.endswith("3") else p.upper() for p in prompts]


def test_one_failure_voids_nothing_else(spark):
    from veriloom.sources.completion import TooManyFailures, checked

    df = spark.createDataFrame([(f"p{i}",) for i in range(10)] + [(None,)], "p string").coalesce(1)
    out = complete(df, "p", Flaky(), batch=4)
    got = {r.p: (r.response, r.error) for r in out.collect()}
    assert got == {f"p{i}": ((f"P{i}", None) if i != 3 else (None, "ValueError: no")) for i in range(10)} | {None: (None, None)}
    assert checked(out, 0.01, least=5) is out
    with pytest.raises(TooManyFailures):
        checked(out, 0.01, least=0)


def test_giving_up(spark):
    class Dead:
        sent = 0

        def complete(self, prompts):
            Dead.sent += len(prompts)
            return [f"sent {Dead.sent}"] if Dead.sent == 1 else [RuntimeError(f"down {Dead.sent}")] * len(prompts)

    df = spark.createDataFrame([(f"p{i}",) for i in range(60)], "p string").coalesce(1)
    errors = [r.error or "" for r in complete(df, "p", Dead(), batch=1, give_up=5).collect()]
    assert sum(e.startswith("RuntimeError: down") for e in errors) == 5 and sum("not sent after 5" in e for e in errors) == 54


def test_log_of_a_search(spark):
    """All calls are logged: those of abandoned attempts and of a record that drops out by a failed call too."""
    from veriloom.plans.search import search_with_events
    from veriloom.sources.completion import TooManyFailures

    class Partly(Script):
        def complete(self, prompts):
            return [RuntimeError("gone") if "lost" in p and p.startswith("Does the") else self.one(p) for p in prompts]

    df = spark.createDataFrame([(1, "q", "g"), (2, "r", "lost")], "process_id long, open_question string, gold_answer string")
    records, events = search_with_events(df, Partly("FFF"), SearchConfig(attempts=2, depth=1))
    assert [(r.process_id, r.archived, r.calls) for r in records.collect()] == [(1, 1, 9)]
    log = sorted((r.process_id, r.attempt, r.round, r.kind, r.valid, r.error) for r in events.collect())
    ok = [(0, 0, "init"), (0, 0, "rethink"), (0, 0, "verify"), (0, 1, "verify"), (1, 0, "rethink"), (1, 1, "final"), (1, 1, "label"), (1, 1, "rewrite"), (1, 1, "verify")]
    assert log == [(1, *x, True, None) for x in ok] + [(2, 0, 0, "init", True, None), (2, 0, 0, "verify", False, "RuntimeError: gone")]
    assert events.filter("kind = 'verify' AND process_id = 1").filter("verdict").count() == 0 and events.filter("size(steps) = 3").count() == 5

    class Broken:
        def complete(self, prompts):
            raise RuntimeError("down")

    many = spark.range(100).selectExpr("id AS process_id", "'q' AS open_question", "'g' AS gold_answer")
    with pytest.raises(TooManyFailures):
        search(many, Broken())


def test_steps_text(spark):
    """As the standard library writes it with an indent of two."""
    rows = [[("Inner Thinking", "t \"q\"", "é 中\n\tb\\", True), ("Inner Thinking", None, None, True), ("Final Conclusion", None, "c", False), ("Verification", None, "v", False)], [("Verification", None, "v", False)]]
    df = spark.createDataFrame([(r,) for r in rows], "s array<struct<action:string,title:string,content:string,has_title:boolean>>")
    want = [[{"action": a} | ({"title": t} if h else {}) | {"content": c} for a, t, c, h in r[:-1]] for r in rows]
    assert [r[0] for r in df.select(X.steps_json(F.col("s"))).collect()] == [json.dumps(w, ensure_ascii=False, indent=2) for w in want]


def test_scores_and_names(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "t string")
    got = [r[0] for r in df.select(rl.scored(F.col("t"), rl.StubScorer(), batch=1)).collect()]
    assert got[0] == pytest.approx(rl.StubScorer().logits(["a"])[0]) and got[1] is None and got[2] is not None
    assert json_files.run_folder("/out/", "r1") == "/out/r1" and json_files.run_folder("/out/r1/x", "r1") == "/out/r1/x"
    files = spark.createDataFrame([(x,) for x in ("pytorch_model-1.bin", "a.safetensors", "b.index.json", "config.json", "pytorch_model.txt")], "n string")
    assert [r.n for r in files.filter(json_files.copied(F.col("n"))).collect()] == ["config.json", "pytorch_model.txt"]
