"""Phrase matches against plain windows; proximity; odd texts."""

from __future__ import annotations

import random

import pytest

from veriloom.llm import leakage as K


@pytest.mark.parametrize("small", [100_000, 0])
def test_phrases(spark, monkeypatch, small):
    monkeypatch.setattr(K, "BROADCAST_BYTES", small)
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 30)))) for i in range(25)]
    han = "".join(chr(0x4E00 + rng.randrange(60)) for _ in range(45))
    items += [(100, han), (101, None), (102, ""), (103, "中文"), (None, items[0][1])]
    texts = []
    for i in range(200):
        src = rng.choice(items[:25])[1].split()
        k = rng.randint(1, len(src))
        a = rng.randint(0, len(src) - k)
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 20))] + src[a : a + k] + [rng.choice(vocab) for _ in range(rng.randint(0, 20))]
        texts.append(("t", i, rng.choice([" ", ", ", "**"]).join(w).upper()))
    texts += [("u", 1, "前" + "，".join(han[5:25]) + "x1"), ("u", 2, han[5:24]), ("u", 3, None), ("u", 4, ""), ("u", None, items[1][1]), ("t", 7, texts[7][2]), ("u", 5, "<b>" + items[2][1].replace(" ", "</b> ") + "&nbsp;")]
    df = spark.createDataFrame(texts, "tbl string, id long, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.tbl, r.id, r.item_id) for r in K.leaks(df, it).collect()}
    want = set()
    for tbl, i, t in texts:
        for j, q in items:
            if i is None or j is None or not t:
                continue
            chinese, terms = K.item_terms(q)
            n = K.PHRASE_HAN - K.GRAM + 1 if chinese else K.PHRASE_WORDS
            own = K.han_terms(t) if chinese else K.word_terms(t)
            wins = {tuple(terms[a : a + n]) for a in range(len(terms) - n + 1)}
            if any(tuple(own[a : a + n]) in wins for a in range(len(own) - n + 1)):
                want.add((tbl, i, j))
    assert got == want and ("u", 1, 100) in got and ("u", 2, 100) not in got and len(got) > 50
    near = {(r.tbl, r.id, r.item_id) for r in K.near_leaks(df, it).collect()}
    assert near
    assert K.leaks(df.limit(0), it).count() == 0 and K.leaks(df, it.limit(0)).count() == 0
