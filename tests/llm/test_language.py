"""Context trees against a plain version; held-out accuracy; odd fields."""

from __future__ import annotations

import collections
import math
import random

import pandas as pd
import pytest

from veriloom.llm import language as L
from veriloom.llm.ppm import ORDER, Ppm


def plain_bits(texts, t):
    data = b"\n" * ORDER + b"".join(x + b"\n" * ORDER for x in texts)
    count = collections.defaultdict(collections.Counter)
    for i in range(ORDER, len(data)):
        if data[i] != 10:
            for k in range(ORDER + 1):
                count[data[i - k : i]][data[i]] += 1
    q, bits = b"\n" * ORDER + t, 0.0
    for i in range(ORDER, len(q)):
        for k in range(ORDER, -2, -1):
            if k < 0:
                bits += 8
                break
            c = count.get(q[i - k : i])
            if c:
                n, d = sum(c.values()), len(c)
                if c[q[i]]:
                    bits += math.log2((n + d) / c[q[i]])
                    break
                bits += math.log2((n + d) / d)
    return bits


def test_exact_code_lengths():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé中") for _ in range(rng.randint(1, 6)))
    samples = {x: [" ".join(word() for _ in range(5)).encode() for _ in range(20)] for x in ("a", "b")}
    m = Ppm(samples)
    texts = [" ".join(word() for _ in range(3)).encode() for _ in range(60)] + [b"", b"zz", samples["a"][0]]
    got = m.score(texts)
    for t, row in zip(texts, got):
        assert row == pytest.approx([plain_bits(samples[x], t) for x in m.langs], abs=1e-3)
        for step in (1, 3, 1000):
            assert m.score_long(t, step) == pytest.approx(row, abs=1e-3)


def test_declared(spark):
    names = ["en", "EN", "en-US", "English", " zho ", "中文", "pt_BR", "de (AT)", "und", "n/a", "", None, "Deutsch", "fr_CA", "spa"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "l string").select(L.declared(__import__("pyspark").sql.functions.col("l"))).collect()]
    assert got == ["en", "en", "en", "en", "zh", "zh", None, "de", None, None, None, None, "de", "fr", "es"]


def test_held_out_accuracy(sf):
    """Trees from half of the smallest table's rows tell the languages of the other half's labelled fields."""
    names = {n: c for c, v in L.NAMES.items() for n in v}
    d = pd.read_parquet(sf.replace("sf0.001", "sf0.01") + "/sft.parquet").drop_duplicates("sft_id")
    d["dec"] = [names.get((x or "").strip().lower().split("-")[0]) for x in d["lang"]]
    d = d[d.dec.notna()]
    train, held = d[d.sft_id % 2 == 0], d[d.sft_id % 2 == 1]
    samples = {x: list(g.question.dropna()) for x, g in train.groupby("dec")}
    segs = L.segments(L.train(samples), [t if isinstance(t, str) else None for t in held.complex_cot])
    main = [max(s, key=lambda x: x[4])[2] if s else None for s in segs]
    told = [(m, x) for m, x in zip(main, held.dec) if m]
    # labels are wrong in some per cent of the rows
    assert len(told) > 150 and sum(m == x for m, x in told) / len(told) > 0.9


def test_fields(spark):
    en, fr, zh = L.GENERAL["en"], L.GENERAL["fr"], L.GENERAL["zh"]
    rows = [
        (1, "en", en, en, en), (1, "en", en, en, en), (2, "fr", fr, fr + " " + en[-60:], None), (3, None, zh, "## Thinking\n\n", "N/A"),
        (4, "zh-CN", zh + en, "- 1) Vorlum fever", "TBD"), (None, "en", fr, "", "   "), (5, "en", en * 60, "Zorbax", "…"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "sft_id long, lang string, question string, complex_cot string, response string, declared string, field string")
    segs = L.label_segments(df, "sft_id", "lang", ["question", "complex_cot", "response"], L.train({}))
    got = sorted(map(tuple, L.wrong_labels(segs).collect()), key=str)
    assert got == sorted([(2, "complex_cot", "fr"), (2, "complex_cot", "en"), (3, "question", "zh"), (4, "question", "zh"), (4, "question", "en"), (None, "question", "fr")], key=str)
    once = L.distinct_segments(segs).filter("id = 1")
    assert once.count() == 3 and once.agg({"confidence": "min"}).first()[0] > 0.9
    assert L.wrong_labels(L.label_segments(df.limit(0), "sft_id", "lang", ["question"])).count() == 0


def test_very_long_sentence():
    m = L.train({})
    text = "the people who live here were asked " * 60_000
    assert [x[2] for x in L.segments(m, [text])[0]] == ["en"]


def test_lists_and_unknown_languages():
    """Sentences of lists count, names do not; what is in no known language has none."""
    m = L.train({})
    de = ["Die Patientin soll jeden Morgen das Medikament nehmen.", "Der Arzt hat den Befund geprüft und nichts gefunden.", "Bitte kommen Sie nach zwei Wochen wieder."]
    for mark in ("- ", "* ", "1. ", "- 2) ", "a) "):
        assert [x[2] for x in L.segments(m, ["\n".join(mark + s for s in de)])[0]] == ["de"]
    none = ["- 1) Vorlum fever\n- 2) zorbax (7 mg)", "Пациент должен принимать лекарство каждое утро.", "患者は毎朝食後に薬を服用する必要があります。", "O paciente deve tomar o medicamento todas as manhãs depois do café."]
    assert L.segments(m, none) == [[], [], [], []]


def test_languages_from_labels(spark):
    """A language that only the labels name, by its code, has a tree of its own."""
    pt = ["O paciente deve tomar o medicamento todas as manhãs.", "A médica não encontrou nada de novo hoje.", "Volte ao hospital depois de duas semanas.", "As dores começaram há três dias durante a noite."]
    rows = [(i, "pt-BR", " ".join([pt[i % 4], pt[(i + 1) % 4], f"Foram {i} dias."])) for i in range(60)] + [(100, None, " ".join(pt[:2])), (101, "en", L.GENERAL["en"]), (102, "pt", L.GENERAL["en"])]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    assert sorted(tuple(r) for r in L.wrong_labels(L.label_segments(df, "id", "lang", ["text"])).collect()) == [(100, "text", "pt"), (102, "text", "en")]
