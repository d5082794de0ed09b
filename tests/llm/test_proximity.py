"""Proximity matches on edited passages against plain counting."""

from __future__ import annotations

import random
from collections import Counter

from veriloom.llm import leakage as K


def _near(texts, items, slop=6, least=4):
    n = Counter(w for _, t in texts for w in t.split())
    out = set()
    for j, q in items:
        terms, places = q.split(), set()
        for s in range(len(terms) - 11):
            places |= set(sorted((p for p in range(s, s + 12) if n[terms[p]]), key=lambda p: (n[terms[p]], p))[:2])
        for i, t in texts:
            w = t.split()
            hits = sorted((p, x) for p in places for x in range(len(w)) if w[x] == terms[p])
            best = 0
            for lo in {b * 2 * slop + o for p, x in hits for o in (0, -slop) for b in [(x - p - o) // (2 * slop)]}:
                own, chain = [h for h in hits if lo <= h[1] - h[0] < lo + 2 * slop], {}
                for h in own:
                    chain[h] = 1 + max((chain[g] for g in chain if g[0] < h[0] and g[1] < h[1]), default=0)
                best = max(best, *chain.values())
            exact = any(f" {' '.join(terms[s : s + 12])} " in f" {t} " for s in range(len(terms) - 11))
            if best >= least or exact:
                out.add((i, j))
    return out


def test_edited(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    items, texts = [], []
    for j in range(12):
        q = [rng.choice(vocab) for _ in range(22)]
        q[10] = f"name{j}"  # in no text: one edit that all windows of the item hold
        items.append((j, " ".join(q)))
        edited = q[:10] + ["other"] + q[11:]
        texts.append((j, " ".join(rng.choice(vocab) for _ in range(15)) + " " + " ".join(edited)))
        texts.append((100 + j, " ".join(reversed(edited))))
    items.append((50, " ".join(f"u{i}" for i in range(12))))  # one window: two anchors, found as an exact match
    texts.append((50, "w1 " + items[-1][1] + " w2"))
    df = spark.createDataFrame([("t", *t) for t in texts], "tbl string, id long, text string")
    got = {(r.id, r.item_id) for r in K.near_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == _near(texts, items)
    assert {(50, 50)} | {(j, j) for j in range(12)} <= got and not any(i >= 100 for i, _ in got)
