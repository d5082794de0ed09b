"""Near-duplicate links against all pairs, also with shards split into blocks."""

from __future__ import annotations

import random

import pytest

from veriloom.llm import neardup as N


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["中文字词语句", "人民网络"]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            if t and rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice(words)
            else:
                t.append(rng.choice(words))
        out.append(rng.choice([" ", ", ", "  "]).join(t).upper() if rng.random() < 0.2 else " ".join(t))
    return out


@pytest.mark.parametrize("postings", [400_000, 150])
def test_all_pairs(spark, monkeypatch, postings):
    monkeypatch.setattr(N, "SHARD_POSTINGS", postings)
    rows = [("t", i, t) for i, t in enumerate(texts(240, 4))] + [("u", i, t) for i, t in enumerate(texts(30, 9))] + [("t", 900, None), ("t", 901, ""), ("t", 902, "?!"), ("t", 3, texts(240, 4)[3])]
    df = spark.createDataFrame(rows, "tbl string, id long, text string").repartition(5)
    got = sorted(map(tuple, N.all_pairs(*N.links(df)).select("tbl", "id_a", "id_b").collect()))
    sets = {(t, i): N.word_set(x) for t, i, x in rows if x}
    keys = sorted(k for k, s in sets.items() if s)
    want = [(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])]
    assert got == want and len(want) > 200


def test_words_and_empty(spark):
    assert N.word_set("Ab-c 1.5 中文字") == {"ab", "c", "1", "5", "中文", "文字"} and N.word_set("中") == {"中"}
    empty = spark.createDataFrame([], "tbl string, id long, text string")
    assert N.all_pairs(*N.links(empty)).count() == 0


def test_long_text_and_groups(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [("t", 1, long), ("t", 2, long + " more"), ("t", 3, "w1 w2 w3"), ("t", 4, "w3 w2 w1"), ("t", 5, "w1 w2 w3 x1"), ("t", 6, "alone")]
    members, pairs = N.links(spark.createDataFrame(rows, "tbl string, id long, text string"))
    assert sorted(r[1:] for r in map(tuple, N.all_pairs(members, pairs).collect())) == [(1, 2), (3, 4), (3, 5), (4, 5)]
    got = {r.id: r.group_id for r in N.groups(members, pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6}


def test_small_pieces(spark, monkeypatch):
    """Blocks of lists, cells of candidates and pieces of classes cut small give the same links; large classes are told out whole."""
    rows = [("t", i, t) for i, t in enumerate(texts(150, 7))] + [("t", 1000 + i, "one text that very many rows have") for i in range(40)] + [("t", 2000 + i, "one text that very many rows had") for i in range(9)]
    df = spark.createDataFrame(rows, "tbl string, id long, text string").repartition(3)
    want = sorted(map(tuple, N.all_pairs(*N.links(df)).collect()))
    for name, value in (("LIST_TEXTS", 9), ("CELL_PAIRS", 5), ("PROBES", 40), ("COPIES", 6)):
        monkeypatch.setattr(N, name, value)
    got = sorted(map(tuple, N.all_pairs(*N.links(df)).collect()))
    assert got == want and sum(a >= 1000 for _, a, _ in got) == 49 * 48 // 2


def test_probe():
    import numpy as np

    lists = (np.array([3, 5, 9]), np.array([-7, 1, 4]), np.array([2, 3, 5]), np.array([0, 2, 1, 0, 1], np.uint32))
    got = N.probe(lists, [np.array([-7, 4]), np.array([-7, 4]), np.array([0, 1, 9]), np.array([-8, 5])], np.array([3, 9, 5, 5]))
    assert got.tolist() == [2, 1, 1, 0]
