"""Prediction by partial matching over bytes, with frozen statistics and vectorised scoring.

Each language has a variable-order context tree over bytes, learned from sample texts: for each context of up
to ORDER bytes, how often which byte followed. Method C gives a byte seen c times after a context with n
followers, d of them distinct, the probability c / (n + d), and the escape to the next shorter context
d / (n + d); below order 0 all bytes are alike. The code length of a text is the sum of the -log2 over its
bytes; the shortest one names the language.

The trees are frozen after training and compiled. The cost of a byte depends only on its context, and
escaping adds, so one table per order maps (context, byte) to the exact costs in all languages at once, and
another maps a context to its escape costs. A byte is looked up at the highest order first; most are found
there. Lookups are numpy gathers over whole batches, never a loop over bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

ORDER = 5
_SEP = b"\n" * ORDER
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """Open-addressing hash table from int64 keys to row numbers."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._slot(keys)
        while len(left):
            free = self.slots[at] == -1
            self.slots[at[free]] = keys[left[free]]  # of several keys for a slot, the last written stays
            won = free & (self.slots[at] == keys[left])
            self.rows[at[won]] = left[won]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for none."""
        at = self._slot(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.rows[at], -1)
        left = np.flatnonzero((seen != keys) & (seen != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            seen = self.slots[at]
            hit = seen == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (seen != -1)
            left, at = left[go], at[go]
        return out


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """For each position, the k bytes before it and its own byte as one number."""
    out = data.astype(np.int64)
    for j in range(1, k + 1):
        out[j:] |= data[:-j].astype(np.int64) << (8 * j)
    return out


class Ppm:
    """Frozen context trees of several languages."""

    def __init__(self, samples: dict[str, Iterable[bytes]]):
        self.langs = sorted(samples)
        n_l = len(self.langs)
        data = {x: np.frombuffer(_SEP + b"".join(t + _SEP for t in samples[x]), np.uint8) for x in self.langs}
        self.costs: list[tuple[_Table, np.ndarray]] = []
        self.escapes: list[tuple[_Table, np.ndarray] | None] = []
        lower_keys, lower = np.arange(256, dtype=np.int64), np.full((256, n_l), 8.0)
        for k in range(ORDER + 1):
            mask = (1 << (8 * k)) - 1
            per = {}
            for x in self.langs:
                g = _grams(data[x], k)[ORDER:]
                per[x] = np.unique(g[data[x][ORDER:] != 10], return_counts=True)
            keys = np.unique(np.concatenate([np.arange(256, dtype=np.int64) if k == 0 else np.empty(0, np.int64), *[p[0] for p in per.values()]]))
            # what the next shorter context would cost: every suffix was itself seen, at order 0 all bytes are listed
            base = lower[np.searchsorted(lower_keys, keys & mask if k else keys & 255)]
            cost = base.copy()
            ctx_keys = np.unique(keys >> 8)
            esc = np.zeros((len(ctx_keys), n_l))
            for i, x in enumerate(self.langs):
                gk, gc = per[x]
                if not len(gk):
                    continue
                ck, first = np.unique(gk >> 8, return_index=True)
                n, d = np.add.reduceat(gc, first), np.diff(np.append(first, len(gk)))
                esc[np.searchsorted(ctx_keys, ck), i] = np.log2((n + d) / d)
                has = np.searchsorted(ctx_keys, keys >> 8)
                cost[:, i] += esc[has, i]
                own = np.searchsorted(keys, gk)
                of = np.searchsorted(ck, gk >> 8)
                cost[own, i] = np.log2((n + d)[of] / gc)
            self.costs.append((_Table(keys), cost.astype(np.float32)))
            self.escapes.append((_Table(ctx_keys), esc.astype(np.float32)) if k else None)
            lower_keys, lower = keys, cost

    def _costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte, after those before it, in each language; separators cost nothing."""
        full = _grams(data, ORDER)
        out = np.zeros((len(data), len(self.langs)), np.float32)
        left = np.flatnonzero(data != 10)
        for k in range(ORDER, -1, -1):
            keys = full[left] & ((1 << (8 * (k + 1))) - 1)
            table, cost = self.costs[k]
            row = table.find(keys)
            hit = row >= 0
            out[left[hit]] += cost[row[hit]]
            left = left[~hit]
            if not len(left):
                break
            table, esc = self.escapes[k]
            row = table.find(keys[~hit] >> 8)
            seen = row >= 0
            out[left[seen]] += esc[row[seen]]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language: an array (texts, languages)."""
        if not texts:
            return np.zeros((0, len(self.langs)))
        data = np.frombuffer(_SEP + b"".join(t + _SEP for t in texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = ORDER + np.concatenate([[0], np.cumsum(size + ORDER)[:-1]])
        total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self._costs(data), axis=0, dtype=np.float64)])
        return total[starts + size] - total[starts]

    def score_long(self, text: bytes, step: int) -> np.ndarray:
        """Code lengths of one text, taken step by step with the bytes before each step as context; the same as score's."""
        data = np.frombuffer(_SEP + text, np.uint8)
        return sum((self._costs(data[a : a + step + ORDER])[ORDER:].sum(axis=0, dtype=np.float64) for a in range(0, max(1, len(text)), step)), np.zeros(len(self.langs)))
