"""Oversized texts to pieces at natural boundaries (problem 9).

The boundaries of a text are places between tokens, graded: end of a paragraph, line, sentence, clause, word,
or inside a word; never inside a character. Dynamic programming over the boundaries finds the pieces: cost(b)
is the least over the ends a before of cost(a) + the penalty of cutting at b + the imbalance of the piece, a
piece from `overlap` tokens before a to b having to stay within the limit. Only natural boundaries (paragraph,
line, sentence) take part, but for stretches that have none within reach; there the next grades are let in.

A piece begins overlap tokens before the end of the one before, or, where that is inside a character, at the
next token before that begins one. Where no such piece fits, as between characters of more tokens than the limit
less the overlap, the overlap of that piece alone is given up; a single character of more tokens than the limit is
a piece by itself, beyond the limit. Nothing is ever cut inside a character, so no byte is lost.

Pieces are counted again as texts of their own. One that is then beyond the limit, as words cut in the middle can
be, is split again by itself under a limit less by the excess, its neighbours staying as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm import tokens

GRADES = ["paragraph", "line", "sentence", "clause", "word", "inside"]
PENALTY = np.array([0.0, 0.05, 0.1, 2.0, 4.0, 10.0])
NATURAL = 2  # grades up to this are natural
PER_CUT = 0.3
BALANCE = 1.0
SLIPPED = 0.02  # a cut whose overlap cannot be exact

FEW = 48  # ends within reach up to which plain Python is faster than arrays

# Kinds of characters: sentence ends, what may close them, marks between clauses, blanks.
_KINDS = {"stop": ".!?。！？…", "wide": "。！？", "closer": "\"')]”’」』）】*", "clause": ",;:，；：、|", "tight": ";|，；：、", "blank": " \t\r", "space": " \t\r\n\x85\xa0\u2028\u2029\u3000" + "".join(map(chr, range(0x2000, 0x200B)))}
_BIT = {kind: np.uint8(1 << k) for k, kind in enumerate(_KINDS)}
_TABLE = np.zeros(1 << 16, np.uint8)
for _kind, _chars in _KINDS.items():
    _TABLE[[ord(_c) for _c in _chars]] |= _BIT[_kind]


def _starts(c: np.ndarray) -> np.ndarray:
    """Byte offsets of the characters of a text, and its end."""
    return np.concatenate([[0], np.cumsum(1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000))])


def grades(text: str, ends: np.ndarray) -> np.ndarray:
    """Grade of cutting text at each of the byte offsets; -1 inside a character. The end of the text is a paragraph's."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(c)
    at = np.arange(n)
    starts = _starts(c)
    kind = _TABLE[np.minimum(c, 0xFFFF)]
    has = lambda k: (kind & _BIT[k]) != 0
    last = lambda keep: np.maximum.accumulate(np.where(keep, at, -1))  # noqa: E731  place of the last such character so far
    full, open_ = last(~has("blank")), last(~has("closer"))
    nxt, before = np.append(c[1:], 10), full
    spaced = np.append(has("space")[1:], True) | (before != at)
    there = before >= 0
    tail = np.where(there, c[before], 0)
    tail_kind = np.where(there, kind[before], 0)
    body = np.where(there, open_[before], -1)
    stop_kind = np.where(body >= 0, kind[body], 0)
    earlier = np.where(before > 0, full[np.maximum(before - 1, 0)], -1)
    twice = (tail == 10) & (earlier >= 0) & (c[earlier] == 10)
    twice |= (nxt == 10) & (np.append(c[2:], [10, 10])[:n] == 10)
    is_ = lambda of, k: (of & _BIT[k]) != 0
    alone = ~((c >= 48) & (c <= 57) | (c >= 65) & (c <= 90) | (c >= 97) & (c <= 122) | (c >= 0xAA))
    out = np.full(n, 5)
    out[spaced | (c >= 0x2E80) | (nxt >= 0x2E80) | alone] = 4  # scripts without blanks, and marks
    out[is_(tail_kind, "clause") & (spaced | is_(tail_kind, "tight"))] = 3
    out[is_(stop_kind, "stop") & (spaced | is_(stop_kind, "wide"))] = 2
    out[(tail == 10) | (nxt == 10) | (nxt == 13)] = 1
    out[twice] = 0
    if n:
        out[-1] = 0
    i = np.minimum(np.searchsorted(starts, ends), n)
    return np.where((starts[i] == ends) & (i > 0), np.append(-1, out)[i], -1)


def cuts(grade: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (first token, end token) of a text of len(grade) tokens; grade[i] is that of cutting behind token i."""
    n = len(grade)
    overlap = max(0, min(overlap, limit // 2))
    if n <= limit:
        return [(0, n)]
    aligned = np.append(True, grade >= 0)  # aligned[p]: a piece may begin at token p
    aligned[n] = True
    begin = np.maximum.accumulate(np.where(aligned, np.arange(n + 1), 0))  # the last such place at or before
    ends = np.flatnonzero(aligned[1:]) + 1
    start = begin[np.maximum(ends - overlap, 0)]
    # where the next character would not fit behind the overlap, a piece begins where the one before ended
    start = np.where(np.append(ends[1:], n) - start > limit, ends, start)
    level = np.maximum(grade[ends - 1], 0)
    level[-1] = 0
    take = level <= NATURAL
    for most in (3, 4, 5):
        edge = np.concatenate([[0], ends[take]])
        wide = np.append(edge[1:], n) - np.concatenate([[0], start[take]]) > limit
        if not wide.any():
            break
        gap = np.searchsorted(edge, ends, "left") - 1
        take = take | wide[gap] & (level <= most)
    take[-1] = True
    ends, start, level = ends[take], start[take], level[take]
    m = max(1, -(-(n - overlap) // (limit - overlap)))
    goal = (n + (m - 1) * overlap) / m
    cost = PENALTY[level] + PER_CUT + SLIPPED * (ends - start != overlap)
    total, back, inf = np.full(len(ends), np.inf), np.full(len(ends), -1), float("inf")
    low = np.minimum(np.searchsorted(start, ends - limit), np.arange(len(ends)))  # first end from which ends[j] can be reached
    known: list[float] = []
    first_of, costs, firsts = start.tolist(), cost.tolist(), low.tolist()
    for j, e in enumerate(ends.tolist()):
        best, k, lo = (costs[j] + BALANCE * ((e - goal) / limit) ** 2 if e <= limit else inf), -1, firsts[j]
        if j - lo <= FEW:
            for i in range(lo, j):
                size = e - first_of[i]
                if size > 0:
                    x = known[i] + costs[j] + BALANCE * ((size - goal) / limit) ** 2
                    if x < best:
                        best, k = x, i
        else:
            size = e - start[lo:j]
            c = total[lo:j] + costs[j] + BALANCE * ((size - goal) / limit) ** 2
            c[size <= 0] = inf
            i = int(np.argmin(c))
            if c[i] < best:
                best, k = float(c[i]), lo + i
        if best == inf:  # one character of more tokens than the limit
            best, k = (known[-1] if j else 0.0) + costs[j], j - 1
            if j:
                start[j - 1] = first_of[j - 1] = int(ends[j - 1])
        known.append(best)
        total[j], back[j] = best, k
    out, j = [], len(ends) - 1
    while j >= 0:
        out.append((int(start[back[j]]) if back[j] >= 0 else 0, int(ends[j])))
        j = back[j]
    return out[::-1]


PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("overlap_tokens", T.IntegerType()),
        T.StructField("boundary", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def pieces_of(text: str, ids: np.ndarray, width: np.ndarray, count: Callable[[str], int], limit: int, overlap: int) -> list[tuple]:
    """Rows of PIECE but for the key. width: bytes of each token id; count: number of tokens of a text."""
    ends = np.cumsum(width[ids])
    grade = grades(text, ends)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = _starts(c)
    char = np.searchsorted(starts, np.concatenate([[0], ends]))  # characters before each token that ends one
    done, wait = [], [(a, b, limit) for a, b in reversed(cuts(grade, limit, overlap))]
    while wait:
        a, b, own = wait.pop()
        lo, hi = int(char[a]), int(char[b])
        n = count(text[lo:hi])
        if n <= limit or hi - lo == 1:
            done.append((lo, hi, n, a, b))
        elif (grade[a : b - 1] >= 0).any():
            # beyond the limit when encoded by itself: split again, under less
            own = max(1, min(own, b - a) - (n - limit))
            wait += [(a + x, a + y, own) for x, y in reversed(cuts(grade[a:b], own, min(overlap, own // 2)))]
        else:  # characters that share a token
            while lo < hi:
                end = next((e for e in range(hi, lo + 1, -1) if count(text[lo:e]) <= limit), lo + 1)
                done.append((lo, end, count(text[lo:end]), b if done and done[-1][4] == b else a, b))
                lo = end
    rows, last = [], None
    for k, (lo, hi, n, a, b) in enumerate(done):
        shared = max(0, last - a) if last is not None else 0
        rows.append((k, lo, hi, n, shared, "end" if hi == len(text) else GRADES[max(grade[b - 1], 0) if hi == char[b] else 5], text[lo:hi]))
        last = b
    return rows


def split_oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: str = "max_tokens", overlap: str = "overlap_tokens", name: str = tokens.DEFAULT, folder: str | None = None) -> DataFrame:
    """Pieces (schema PIECE) of the texts of more than `limit` tokens; texts within it, null texts or limits give none.

    A limit below 1 counts as none, an overlap above half the limit as half. Together the pieces hold the whole
    text. A piece is beyond the limit only if it is one character of more tokens than that. Texts with no more bytes than the limit cannot have more tokens and are not encoded.
    """
    folder = tokens.tokenizer_dir(folder)
    cols = [F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(limit).cast("int").alias("limit"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("overlap")]
    large = df.select(*cols).filter((F.col("limit") >= 1) & (F.octet_length("text") > F.col("limit")))
    coded = tokens.encode(large, "text", name, folder).filter(F.size("ids") > F.col("limit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = tokens.ranks(name, folder)
        width = np.zeros(max(table.values()) + 1, np.int64)
        for piece, i in table.items():
            width[i] = len(piece)
        count = tokens.counter(name, folder)
        names = [f.name for f in PIECE]
        for b in batches:
            for lo in range(0, len(b), 200):
                rows = [(d, *r) for d, t, i, m, o in b.iloc[lo : lo + 200][["doc_id", "text", "ids", "limit", "overlap"]].itertuples(index=False) for r in pieces_of(t, np.asarray(i), width, count, int(m), int(o))]
                out = pd.DataFrame(rows, columns=names)
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return coded.select("doc_id", "text", "ids", "limit", "overlap").mapInPandas(run, PIECE)
