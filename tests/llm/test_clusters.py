"""Clusters of openings against all pairs."""

from __future__ import annotations

import random

from veriloom.llm import templates


def _components(units):
    sets = {u: set(templates.shingles(u.split(" "))) for u in units}
    rep = {u: u for u in units}

    def root(u):
        while rep[u] != u:
            u = rep[u]
        return u

    links = [(u, v) for u in units for v in units if u < v and len(sets[u] & sets[v]) / len(sets[u] | sets[v]) >= templates.SIMILAR]
    for u, v in links:
        a, b = sorted((root(u), root(v)))
        rep[b] = a
    return links, {u: root(u) for u in units}


def test_all_links(spark, monkeypatch):
    monkeypatch.setattr(templates, "BLOCK", 3)
    rng = random.Random(5)
    units = set()
    for k in range(6):
        base = [f"w{k}x{i}" for i in range(rng.choice([6, 15, 30, 45]))]
        for _ in range(8):
            # chains: each is the one before with the first or last words shifted out or replaced
            base = base[1:] + [f"n{rng.randrange(10**6)}"] if rng.random() < 0.5 else [f"n{rng.randrange(10**6)}"] + base[1:]
            units.add(" ".join(base))
    units |= {"short", "a b c d e", "a b c d e f"}
    units = sorted(units)
    links, want = _components(units)
    names = {templates.code(u): u for u in units}
    found = templates.clusters(spark.createDataFrame(list(names.items()), "unit long, text string")).collect()
    groups = lambda rep: {frozenset(u for u in rep if rep[u] == r) for r in rep.values()}
    linked = {u for x in links for u in x}
    assert len(links) > 20 and groups({names[r.unit]: r.cluster for r in found}) == groups({u: r for u, r in want.items() if u in linked})
