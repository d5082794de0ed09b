"""Truncated texts and broken pairs on small fixtures."""

from __future__ import annotations

import random

import pytest

from veriloom.llm import language, pairs, truncation

BASE = ["The patient should take the medicine every morning.", "A second visit after some weeks is useful.", "The findings do not change the plan of treatment.", "Please measure the pressure again before the visit."]


def corpus(n=60):
    rng = random.Random(2)
    return [" ".join(rng.choice(BASE) for _ in range(5)) for _ in range(n)]


CASES = [
    ("It was fine. The patient should take the medi", "mid_word"),
    ("It was fine. The patient should take the medicine", "mid_sentence"),
    ("It was fine. The patient should, ", "mid_sentence"),
    ("It was fine. The pati…", "marked"),
    ("It was fine. The pati�", "mid_char"),
    ("It was fine.\n\n## Find", "mid_word"),
    ("应选择药物治疗。建议复查", "mid_sentence"),
    ("It was fine.", None),
    ("It was fine.</s>", None),
    ("It was fine. **C**", None),
    ("It was fine.\n\n- 1) Vorlum fever\n- 2) zorbax (7 mg)", None),
    ("It was fine.\nAnswer: B", None),
    ("应选择药物。", None),
    ("正确答案：（C）", None),
    ("## Thinking\n\n", None),
    ("N/A", None),
    ("", None),
    ("​", None),
    (None, None),
]


def test_cuts(spark):
    rows = [("t", i, "s", t) for i, t in enumerate(corpus())] + [("t", 1000 + i, None, t) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "tbl string, id long, source string, text string, word string, empty boolean")
    assert truncation.cut_texts(df).columns == ["tbl", "id", "source", "word", "cut", "at_limit", "empty"]
    got = {r.id: r.cut for r in truncation.cut_texts(df).collect()}
    assert len(got) == len(rows)
    assert {i: got[1000 + i] for i in range(len(CASES))} == {i: c for i, (_, c) in enumerate(CASES)}
    assert all(got[i] is None for i in range(60))
    rates = {r.source: (r.n_texts, r.n_cut) for r in truncation.cut_rates(truncation.cut_texts(df)).collect()}
    assert rates == {"s": (60, 0), None: (len(CASES), 7)}
    assert truncation.cut_texts(df.limit(0)).count() == 0


def test_limits(spark):
    rng = random.Random(1)
    cut = [("t", i, "s", (f"word{i} " * 80)[:300]) for i in range(40)] + [("t", 900 + i, "s", "y" * 200) for i in range(40)] + [("t", 100 + i, "s", "x" * rng.randint(30, 700)) for i in range(60)]
    df = spark.createDataFrame(cut, "tbl string, id long, source string, text string")
    found = truncation.limits(df.selectExpr("tbl", "length(text) AS n_chars", "xxhash64(text) AS h"), "tbl")
    # many texts that are the same are one
    assert [r.n_chars for r in found.filter(f"bits >= {truncation.AT_LIMIT_BITS}").collect()] == [300]


def test_trie(spark):
    w = spark.createDataFrame([("ab", 2, 1), ("abc", 3, 0), ("疗法", 4, 2)], "word string, n long, closing long")
    names = {r.h: r.w for r in spark.createDataFrame([(x,) for x in ("a", "ab", "abc", "疗", "疗法")], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    assert {names[r.key]: (r.as_word, r.below, r.closing) for r in truncation.trie(w).collect()} == {"a": (0, 5, 0), "ab": (2, 3, 1), "abc": (3, 0, 0), "疗法": (4, 0, 2)}


def test_vocabulary(spark):
    t = spark.createDataFrame([("ab, cd.\nAb cd",), ("药物。药物 x",), (None,), ("",)], "text string")
    got = {r.word: (r.n, r.closing) for r in truncation.vocabulary(t).collect()}
    assert got == {"ab": (1, 0), ",": (1, 0), "cd": (1, 1), "Ab": (1, 0), "药": (2, 0), "物": (2, 1), "药物": (2, 1)}


WHOLE = ["Aspirin 81 mg daily", "Community-acquired pneumonia", "Acute appendicitis, treat with surgery"]


def test_unpunctuated_answers_are_whole(spark):
    """Whole answers without a stop are not cut, however often they recur; a final word behind which nothing ends is."""
    rows = [("t", i, t) for i, t in enumerate(corpus())] + [("t", 1000 + 100 * k + i, t) for k, t in enumerate(WHOLE) for i in range(50)]
    rows += [("t", 5000, "A second visit after some")]
    got = truncation.cut_texts(spark.createDataFrame(rows, "tbl string, id long, text string"), evidence=True).collect()
    assert all(r.cut is None for r in got if r.id < 5000)
    last = next(r for r in got if r.id == 5000)
    assert last.follow_bits > 2 and last.stop_bits == -5


@pytest.mark.parametrize(("text", "empty"), [("N/A" + " " * 500, True), ("TBD" + "\n" * 450, True), ("-" * 5000, True), ("# a\n" * 300, True), ("# a\n" * 300 + "so", False), ("none of these", False), ("\u200b" * 900, True)])
def test_long_empty_texts(spark, text, empty):
    df = spark.createDataFrame([("t", 1, text)], "tbl string, id long, text string")
    assert truncation.cut_texts(df).first().empty is empty


def test_many_end_marks_and_long_words(spark):
    rows = [("t", 1, "It was fine." + "</s>" * 40), ("t", 2, "It was fine. " + "a" * 3000)]
    got = {r.id: r for r in spark.createDataFrame(rows, "tbl string, id long, text string").select("id", truncation.trimmed(__import__("pyspark").sql.functions.col("text")).alias("t")).collect()}
    assert got[1].t == "It was fine."
    words = spark.createDataFrame([("a" * 4000, 5, 0)], "word string, n long, closing long")
    cut = {r.id: r.cut for r in truncation.cut_texts(spark.createDataFrame(rows, "tbl string, id long, text string"), words).collect()}
    assert cut == {1: None, 2: "mid_word"}


Q = "A man of 40 years has had a dry cough for nine days and sleeps badly at night. The heart is sound and the lungs are clear. What should be given next?"


@pytest.mark.parametrize(
    ("text", "same"),
    [(Q, True), (Q.lower(), True), (Q.replace(" ", " " * 10), True), ("**" + Q.replace(". ", ".**\n\n\n**") + "**", True), ("Question: " + Q, True), (Q.replace(".", " ").replace(",", " "), True), (Q[: Q.rindex(".") + 1], True), (Q[:60], False), (Q + " Please take the medicine that helps you most every day.", False), ("He should rest.", False)],
)
def test_copy(text, same):
    assert pairs.is_copy(text, Q) is same


def test_defects(spark):
    en, de = language.GENERAL["en"], language.GENERAL["de"]
    tail = [" ".join(BASE[(i + k) % 4] for k in range(4)) for i in range(40)]
    rows = [(i, "en", f"{Q} Case {i}.", t, f"As an AI I may be wrong, yet it is plain. {t}" if i % 2 else t) for i, t in enumerate(tail)]
    rows += [(100 + i, "en", f"{Q} Case {i}.", tail[i % 40], "I'm sorry, but I can't help with that request." + (" This topic is outside what I may discuss." if i % 3 == 0 else "")) for i in range(8)]
    special = {
        200: (en, de, "other_language"), 201: (Q, Q, "copy"), 202: (Q, "Question: " + Q, "copy"), 203: (Q, None, "empty"), 204: (Q, "TBD", "empty"), 205: (Q, "## Final Response\n\n", "empty"), 206: (Q, BASE[0] + " The patient sho", "truncated"),
        207: (None, en, None), 208: (Q, BASE[0] + "\n- 1) Vorlum fever", None), 209: (Q, "抱歉，我无法回答这个问题。", "refusal"),
    }
    rows += [(i, "en", q, en, a) for i, (q, a, _) in special.items()]
    rows += [rows[0], rows[-1]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "sft_id long, lang string, question string, complex_cot string, response string, unit string")
    out = pairs.defects(df, "sft_id", "lang", "question", ["complex_cot", "response"])
    got = {(r.id, r.field): r.defect for r in out.collect()}
    assert len(got) == out.count()
    want = {(i, "response"): k for i, (_, _, k) in special.items() if k} | {(100 + i, "response"): "refusal" for i in range(8)}
    want[200, "complex_cot"] = "copy"
    assert got == want
    assert pairs.defects(df.limit(0), "sft_id", "lang", "question", ["response"], language.train({})).count() == 0


def _pairs(spark, rows):
    return spark.createDataFrame([(i, "en", q, language.GENERAL["en"], a) for i, (q, a) in enumerate(rows)], "sft_id long, lang string, question string, complex_cot string, response string")


def _prompt(i):
    return " ".join(f"p{i}w{k}" for k in range(12)) + "?"


def test_long_refusals_and_short_answers(spark):
    """A refusal of seven sentences is one; a short answer that recurs is none, nor is what copies of one prompt get."""
    no = ["I cannot answer this.", "I am not able to discuss it.", "I must decline to answer.", "I am afraid I cannot help.", "I cannot give advice.", "It is outside what I may discuss.", "I am unable to assist with this request."]
    rows = [(_prompt(i), "The correct answer is option B.") for i in range(8)] + [(_prompt(20), " ".join(no))]
    got = {(r.id, r.defect) for r in pairs.defects(_pairs(spark, rows), "sft_id", "lang", "question", ["response"]).collect()}
    assert got == {(8, "refusal")}


def test_templates_without_wordings(spark, monkeypatch):
    """Templates that are the whole answer to unrelated prompts, alone and beside each other, decline; the wordings are not needed."""
    from veriloom.llm import templates

    monkeypatch.setattr(templates, "DECLINE", [])
    rng = random.Random(4)
    no = ["Nulla da dire su questo argomento oggi.", "Su questo argomento non parlo mai con nessuno.", "Di {} non posso dire proprio nulla qui adesso."]
    content = [f"Part {k} says that the number {{}} is the right one for all of us." for k in range(9)]
    said = lambda t, i: t.format(f"n{i}")
    rows = [(_prompt(i), " ".join(said(t, i) for t in rng.sample(content, 4))) for i in range(60)]
    first = len(rows)
    rows += [(_prompt(100 + i), said(no[i % 3], i) + (" " + said(no[(i + 1) % 3], i) if i % 4 == 0 else "")) for i in range(36)]
    feats = pairs.features(_pairs(spark, rows), "sft_id", "question", ["response"], language.train({}))
    openings = feats.selectExpr("units[0].unit AS unit", "opening AS text").dropDuplicates(["unit"])
    got = {r.id for r in templates.refusals(feats.select("id", "field", "prompt", "units"), openings).collect()}
    assert got == set(range(first, len(rows)))


def test_cues_and_sketches(sf):
    """No wording goes unseen for want of a cue; edited copies of a prompt mostly have one sketch, others differ."""
    import re

    import pandas as pd

    from veriloom.llm import templates

    pattern = re.compile("|".join([*(f"(?:{p})" for p in templates.DECLINE), templates.POLITE]), re.I | re.S)
    d = pd.read_parquet(sf.replace("sf0.001", "sf0.01") + "/sft.parquet")
    hits = 0
    for t in [*d.response.dropna(), *d.complex_cot.dropna()]:
        for a, b in language.sentences(t):
            u = templates.unit(pairs.words(t[a:b]))
            if pattern.search(templates._HAN_GAP.sub("", u)):
                hits += 1
                assert not templates.CUES.isdisjoint(u.split(" "))
    assert hits > 5
    w = [f"w{i}" for i in range(60)]
    edited = [w[:k] + ["x"] + w[k + 1 :] for k in range(0, 60, 3)]
    assert len(set(templates.sketches(edited, range(20)))) <= 4
    assert templates.sketches([[], ["a"], ["a"], ["b"], ["a", "b"]], range(5))[0] == 0
    assert len(set(templates.sketches([[], ["a"], ["a"], ["b"], ["a", "b"]], range(5)))) == 4


def test_lazy_languages_are_the_same():
    """Main language and foreignness, scored as far as needed, are those of all segments."""
    m, rng = language.train({}), random.Random(3)
    parts = [language.GENERAL[x][a:b] for x in language.GENERAL for a, b in language.sentences(language.GENERAL[x])]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(200)] + ["", None, "N/A", "Zorbax"]
    bounds = [language.sentences(t) if t else [] for t in texts]
    segs = language.segments(m, texts)

    def main(x):
        size = {}
        for s in x:
            size[s[2]] = size.get(s[2], 0) + s[4]
        return max(sorted(size), key=size.get) if size else None

    assert language.main_languages(m, texts, bounds) == [main(x) for x in segs]
    own = [rng.choice(["en", "de", None]) for _ in texts]
    assert language.wholly_foreign(m, texts, bounds, own) == [bool(o and x and all(s[2] != o for s in x)) for o, x in zip(own, segs)]
