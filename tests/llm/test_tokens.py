"""Token ids against the tokenizer, round trips, mixtures and splits."""

from __future__ import annotations

import random

import numpy as np
import pytest

from veriloom.llm import mixing, splitting, tokens

ODD = [None, "", " ", "\n\n  x", "it's  ok<|endoftext|>", "中文，测试。　空", "é́ 🧬‍", "a" * 5000, "﻿ \t\r\n", "1234567 8.5", "don't DON'T we'll", "x y", "\x85z", " q", "\x1c\x1d a"]


def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_dir() + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture
def docs(spark):
    rng = random.Random(8)
    alphabet = "abc XYZ09.,'\n\t中文字é🧬  　-"
    rows = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)] + ["same text"] * 3
    return spark.createDataFrame([(i if i else None, t, "w", [1]) for i, t in enumerate(rows)], "doc_id long, text string, _block string, ids array<int>").repartition(4)


def test_ids_and_round_trip(docs, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 5000)
    enc = exact()
    coded = tokens.encode(docs)
    rows = coded.collect()
    assert len(rows) == docs.count() and coded.columns == ["doc_id", "text", "_block", "ids"]
    assert [r.doc_id for r in rows if list(r.ids) != enc(r.text)] == []
    back = {r.doc_id: r.text for r in tokens.decode(coded, "doc_id").collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in rows)
    assert tokens.encode(docs.limit(0)).count() == 0


def test_permutation_and_quotas():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 5)) == list(range(n))
    blocks = np.array([50, 1, 0, 333])
    for shards in (1, 2, 7, 32):
        parts = [mixing.quota(blocks, s, shards, 3) for s in range(shards)]
        assert sum(c for _, c in parts).tolist() == blocks.tolist()
        for i in range(4):
            ranges = sorted((int(f[i]), int(f[i] + c[i])) for f, c in parts if c[i])
            assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:])) and (not ranges or (ranges[0][0], ranges[-1][1]) == (0, blocks[i]))
        assert max(c.sum() for _, c in parts) - min(c.sum() for _, c in parts) <= 1


def test_hypergeometric_mean():
    got = [mixing.quota(np.array([100, 300]), 0, 4, seed)[1] for seed in range(300)]
    assert np.mean([g[0] for g in got]) == pytest.approx(25, abs=1) and all(g.sum() == 100 for g in got)


def test_shares():
    plan = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 5), ("none", 0.1, 1), (None, 0.1, 1)]
    got = {s.source: s.want for s in mixing.shares({"a": 1000, "b": 1000, "c": 10}, plan)}
    assert got == pytest.approx({"a": 125, "b": 75, "c": 50})
    got = {s.source: s.want for s in mixing.shares({"a": 1000, "b": 1000, "c": 10}, plan, total=1000)}
    assert got["c"] == 50 and sum(got.values()) == pytest.approx(1000) and got["a"] / got["b"] == pytest.approx(5 / 3)
    assert mixing.shares({}, plan) == []


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rng = random.Random(1)
    rows = [(i, "a" if i % 3 else "b", rng.randint(0, 90)) for i in range(3000)] + [(9000, None, 5), (9001, "x", 5), (9002, "c", 40), (9003, "c", None)]
    df = spark.createDataFrame(rows, "key long, source string, n_tokens int")
    plan = spark.createDataFrame([("a", 0.6, 2), ("b", 0.399, 1), ("c", 0.001, 4), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(df, plan, shard_tokens=9000)
    got = m.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(df.repartition(7), plan, shard_tokens=9000).collect()))
    assert len({(r.key, r.repeat) for r in got}) == len(got) and {r.source for r in got} == {"a", "b", "c"}
    r = {x.source: x for x in mixing.report(m, plan).collect()}
    assert r["a"].actual_share == pytest.approx(0.6, abs=0.01) and r["b"].actual_share == pytest.approx(0.399, abs=0.01)
    assert r["c"].most_repeats <= 4 and r["a"].most_repeats <= 2 and r["d"].n_rows == 0
    by = {}
    for x in got:
        by.setdefault(x.shard, []).append(x.pos)
    assert all(sorted(p) == list(range(len(p))) for p in by.values()) and len(by) > 3
    with pytest.raises(ValueError):
        mixing.mixture(df, plan.union(plan))
    assert mixing.mixture(df.limit(0), plan).count() == 0


def test_pieces(spark, docs):
    rng = random.Random(6)
    words = ["alpha", "beta", "中文字符", "gamma.", "delta,", "。", "\n", "\n\n", "epsilonzetaeta", "é", "42"]
    rows = [(i, rng.choice([" ", ""]).join(rng.choice(words) for _ in range(rng.randint(1, 400))), rng.choice([16, 40, 64]), rng.choice([0, 4, 8])) for i in range(150)]
    rows += [(1000, None, 10, 0), (1001, "", 10, 0), (1002, "short", 10, 0), (1003, "x " * 50, None, 0), (1004, "y " * 50, 10, None), (1005, "🧬" * 30, 4, 9), (None, "z " * 40, 10, 2), (1006, "z " * 40, 0, 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, max_tokens int, overlap_tokens int, limit string")
    enc = exact()
    got = {}
    for p in splitting.split_oversized(df).collect():
        got.setdefault(p.doc_id, []).append(p)
    want = {i for i, t, m, _ in rows if t and m and len(enc(t)) > m}
    assert set(got) == want and None in want and 1004 in want
    for i, t, m, o in rows:
        if i not in got or m < 16:
            continue
        ps = sorted(got[i], key=lambda p: p.piece_no)
        assert ps[0].start_char == 0 and ps[-1].end_char == len(t)
        for p in ps:
            assert p.text == t[p.start_char : p.end_char] and p.n_tokens == len(enc(p.text)) <= m
        for a, b in zip(ps, ps[1:]):
            assert b.start_char <= a.end_char < b.end_char and o <= b.overlap_tokens <= o + 3
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_natural_boundaries(spark):
    t = "The first sentence is here. The second one follows it. " * 12
    df = spark.createDataFrame([(1, t, 40, 0)], "doc_id long, text string, max_tokens int, overlap_tokens int")
    assert {p.boundary for p in splitting.split_oversized(df).collect()} == {"sentence", "end"}


def test_cuts_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        n, limit, overlap = rng.randint(5, 24), rng.randint(4, 9), rng.randint(0, 2)
        grade = np.array([rng.choice([0, 1, 2]) if rng.random() < 0.5 else 4 for _ in range(n)])
        got = splitting.cuts(grade, limit, overlap)
        assert got[0][0] == 0 and got[-1][1] == n and all(b - a <= limit for a, b in got)
        assert all(y[0] == max(0, x[1] - overlap) and y[1] > x[1] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize(("low", "high", "n"), [(0x3400, 0x4DBF, 40), (0x20000, 0x2A000, 10), (0x1F900, 0x1F9FF, 20)])
@pytest.mark.parametrize(("limit", "overlap"), [(2, 1), (3, 0), (4, 1), (4, 2), (8, 4)])
def test_characters_of_many_tokens(spark, low, high, n, limit, overlap):
    """No piece is cut inside a character or loses one; only a lone character may be beyond the limit."""
    rng = random.Random(low + limit)
    rare = "".join(chr(rng.randint(low, high)) for _ in range(n))
    enc = exact()
    for text in (rare, "word one, two. " * 9 + rare + " and more of it. " * 9):
        width = np.zeros(50_300, np.int64)
        for piece, i in tokens.ranks(tokens.DEFAULT, tokens.tokenizer_dir()).items():
            width[i] = len(piece)
        ps = splitting.pieces_of(text, np.asarray(enc(text)), width, lambda t: len(enc(t)), limit, overlap)
        assert (ps[0][1], ps[-1][2]) == (0, len(text))
        assert all(p[6] == text[p[1] : p[2]] and p[3] == len(enc(p[6])) for p in ps)
        assert all(p[3] <= limit or len(p[6]) == 1 for p in ps)
        assert all(b[1] <= a[2] < b[2] for a, b in zip(ps, ps[1:]))


def test_a_row_delivered_very_often(spark, monkeypatch):
    """A block of one repeated row is dealt to parts; rows and ids stay the same."""
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 2000)
    rows = [(1, "the same words, again and again")] * 900 + [(i, f"other words {i}, 中文") for i in range(2, 60)]
    got = tokens.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    enc = exact()
    assert len(got) == len(rows) and all(list(r.ids) == enc(r.text) for r in got)


def test_places_over_racks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    monkeypatch.setattr(mixing, "RACK", 3)
    rng = random.Random(5)
    rows = [(i, "ab"[i % 2], rng.randint(0, 9)) for i in range(400)]
    got = mixing.places(spark.createDataFrame(rows, "key long, source string, n_tokens int"), 3, 400).collect()
    for s in "ab":
        own = sorted((r.start, r.n_tokens) for r in got if r.source == s)
        assert [x for x, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and len(own) == 200
