"""Golden answers, and the cascade against a plain version on random texts."""

from __future__ import annotations

import difflib
import random
import re

import pytest

from veriloom.operators import answers

OPTIONS = [("A", "aspirin"), ("B", "heparin"), ("C", "warfarin"), ("D", "insulin")]
SCHEMA = "output string, options array<struct<label:string,text:string>>"
GOLDEN = [
    ("The answer is B. On reflection the answer is C", "B", "C", 1),
    ("A patient needs (B)", "B", "B", 1),
    ("answer is Not sure", "N", "N", 1),
    ("first A. then D", "A", "D", 1),
    ("选B项", "B", "B", 1),
    ("## Thinking\n\nanswer is A\n\n## Final Response\n\nThe best option: **C**", "C", "C", 1),
    ("give heparin, then aspirin, then heparin", "A", "B", 2),
    ("aspirin first, warfarin later", "C", "C", 2),
    ("take inslin", "D", "D", 3),
    ("zzzz", "D", "D", 3),
    ("", "D", "D", 3),
    ("A B C", "B", "B", 1),
    ("ABCD", "B", "B", 3),
    ("Answer is: A", "A", "A", 1),
    ("the answer is\n\nD", "D", "D", 1),
    ("option E is right", "D", "D", 3),
]


def plain(text: str, options: list[tuple[str, str]]) -> tuple[str, str, int]:
    text = text.rsplit("## Final Response\n\n", 1)[-1]
    found = re.findall(r"answer is\s*?([A-N])", text, re.S)
    if not found:
        letters = "".join(x for x, _ in zip("ABCDEFGHIJKLMN", options))
        found = [m[1] for m in re.finditer(r"(?:[一-鿿]|is |\W|^|#)(?![aA] )([" + letters + r"])(?:\W|[一-鿿]|$)", text, re.S)]
    if found:
        return found[0], found[-1], 1
    low = text.lower()
    seen = [(low.find(o.lower()), low.rfind(o.lower()), -i, x) for i, (x, o) in enumerate(options) if o.lower() in low]
    if seen:
        return max(seen, key=lambda s: (s[0], s[2]))[3], max(seen, key=lambda s: (s[1], s[2]))[3], 2
    best = max((difflib.SequenceMatcher(None, o.lower(), low).ratio(), i) for i, (_, o) in enumerate(options))[1]
    return options[best][0], options[best][0], 3


def run(spark, rows):
    return [(r.ans_first, r.ans_last, r.ans_type) for r in answers.extract(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()]


def test_golden(spark):
    assert run(spark, [(g[0], OPTIONS) for g in GOLDEN]) == [g[1:] for g in GOLDEN]
    assert [plain(g[0], OPTIONS) for g in GOLDEN] == [g[1:] for g in GOLDEN]


def test_random_texts(spark):
    rng = random.Random(5)
    parts = ["answer is ", "A", "B", "C", "D", "E", " ", " is ", "是", "项", "选", "（", "）", "(", ")", "*", "**", "\n", "\r\n", "aspirin", "Heparin", "warfarin", "a ", "é", " ", "。", ".", "#", "'", "x", "1", "_"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), OPTIONS[: rng.randint(1, 4)]) for _ in range(1500)]
    assert run(spark, rows) == [plain(*r) for r in rows]


def test_nulls_and_empty_options(spark):
    assert run(spark, [(None, OPTIONS), ("zz", []), ("answer is A", [])]) == [(None, None, None), (None, None, 3), ("A", "A", 1)]


@pytest.mark.parametrize("ignore", [False, True])
def test_score(spark, ignore):
    rows = [("s", "The answer is A", OPTIONS, "a"), ("s", "zzzz", OPTIONS, "D"), (None, "zzzz", OPTIONS, "A")]
    df = spark.createDataFrame(rows, "source string, output string, options array<struct<label:string,text:string>>, answer_idx string")
    got = {r.source: (r.score, r.head_hits, r.total, r.tail_hits) for r in answers.score(answers.extract(df), ignore_miss=ignore).collect()}
    assert got == ({"s": (1.0, 1, 1, 1), "unknown": (None, 0, 0, 0)} if ignore else {"s": (1.0, 2, 2, 2), "unknown": (0.0, 0, 1, 0)})


def test_gold_containment(spark):
    from pyspark.sql import functions as F

    from veriloom.functions import text as X

    df = spark.createDataFrame([("Take Heparin.", ["heparin"]), ("heparins", ["heparin"]), ("a+b", ["a+b"]), (r"x\E y", [r"x\E"]), (None, ["a"])], "p string, g array<string>")
    assert [r[0] for r in df.select(X.contains_answer(F.col("p"), F.col("g"))).collect()] == [True, False, True, False, False]  # the gold text is not lower-cased
