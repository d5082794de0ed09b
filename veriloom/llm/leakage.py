"""Evaluation items inside training texts, by a distributed positional inverted index (problem 6).

An item is a sequence of terms: of its words, or, if it is Chinese, of each run of GRAM neighbouring characters,
all other characters left out. Every window of PHRASE_WORDS words (PHRASE_HAN characters) of an item is a query
phrase. Terms of texts are made alike, whatever case, punctuation, markup and spacing.

1. How often each term of the items occurs in all texts. Windows with a term that never occurs are out.
2. The two rarest terms of each remaining window are its anchors. The index stores the postings (term, text,
   position) of all anchors over all texts.
3. Each window's two lists are intersected, adjusted by the places of the anchors in the window: what is left
   are texts that have both anchors at the right distance, with the start of the phrase.
4. The texts so found are read once more, each once, and the whole phrases compared by fingerprints of 128 bits, which
   candidates carry along; neither texts nor items are copied for it.

Why not the postings of all training tokens: see the README for their size. Terms travel as 64-bit hashes; a
collision can only add candidates, which the last step takes out. What is broadcast, the item side (terms, windows) or the
texts with candidates, has at most BROADCAST_BYTES, counted before; what has more is joined by shuffle. The postings of a
term that a third of the texts hold are joined by (term, text, position), so no list is gathered in one task.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.operators.relational import assign_ids
from veriloom.session import materialise

PHRASE_WORDS = 12
PHRASE_HAN = 20
GRAM = 4
BROADCAST_BYTES = 16 << 20

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|&(?:[a-z]{2,8}|#\d{1,6});")
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[一-鿿㐀-䶿]+")


def word_terms(text: str) -> list[str]:
    """The words of a text."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def han_terms(text: str) -> list[str]:
    """The neighbouring GRAM Chinese characters of a text, all others left out."""
    h = "".join(_HAN.findall(text))
    return [h[i : i + GRAM] for i in range(len(h) - GRAM + 1)]


def item_terms(text: str | None) -> tuple[bool, list[str]]:
    """(whether it is Chinese, terms) of an item."""
    if not text:
        return False, []
    han = sum(map(len, _HAN.findall(text)))
    chinese = 2 * han > sum(c.isalpha() for c in text)
    return chinese, han_terms(text) if chinese else word_terms(text)


def _hash(terms: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(terms, dtype=object), categorize=False).view(np.int64) if terms else np.empty(0, np.int64)


def _sized(small: DataFrame, width: int, each: int = 0, of: str = "") -> DataFrame:
    """small with a broadcast hint if it is proven small: rows of `width` bytes and `each` more for each element of array `of`."""
    size = F.count("*") * width + (F.coalesce(F.sum(F.size(of)), F.lit(0)) * each if of else F.lit(0))
    return F.broadcast(small) if small.agg(size).first()[0] <= BROADCAST_BYTES else small


def _prints(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each run of n term hashes."""
    out = []
    with np.errstate(over="ignore"):
        for m in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            x = h.view(np.uint64)
            run = np.zeros(len(x) - n + 1, np.uint64)
            for k in range(n):
                run = (run ^ x[k : k + len(run)]) * m
                run ^= run >> np.uint64(31)
            out.append(run.view(np.int64))
    return out[0], out[1]


def windows(items: DataFrame) -> DataFrame:
    """(item_id, start, off, term, print1, print2): terms of every window of the items (item_id, text), and the window's fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for i, t in zip(b["item_id"], b["text"]):
                chinese, terms = item_terms(t)
                n = PHRASE_HAN - GRAM + 1 if chinese else PHRASE_WORDS
                h = _hash(terms)
                if len(h) >= n:
                    w = np.lib.stride_tricks.sliding_window_view(h, n)
                    one, two = _prints(h, n)
                    parts.append(pd.DataFrame({"item_id": i, "start": np.repeat(np.arange(len(w)), n), "off": np.tile(np.arange(n), len(w)), "term": w.ravel(), "print1": np.repeat(one, n), "print2": np.repeat(two, n), "chinese": chinese}))
            if parts:
                yield pd.concat(parts)

    return items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null").mapInPandas(run, "item_id long, start int, off int, term long, print1 long, print2 long, chinese boolean")


def _scan(texts: DataFrame, terms: np.ndarray, positions: bool) -> DataFrame:
    """Occurrences of the given terms (sorted hashes) in texts (tbl, id, text): counts, or postings."""
    held = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = held.value
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                b = whole.iloc[lo : lo + 1000]
                both = [(word_terms(t), han_terms(t)) if isinstance(t, str) else ([], []) for t in b["text"]]
                for kind in (0, 1):
                    flat = [w for x in both for w in x[kind]]
                    if not flat:
                        continue
                    codes, uniques = pd.factorize(np.array(flat, dtype=object))
                    h = _hash(list(uniques))
                    at = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                    hit = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
                    if positions:
                        size = np.array([len(x[kind]) for x in both])
                        row = np.flatnonzero(hit[codes])
                        doc = np.searchsorted(np.cumsum(size), row, "right")
                        yield pd.DataFrame({"term": h[codes[row]], "tbl": b["tbl"].to_numpy()[doc], "id": b["id"].to_numpy()[doc], "pos": row - (np.cumsum(size) - size)[doc]})
                    else:
                        yield pd.DataFrame({"term": h[hit], "n": np.bincount(codes, minlength=len(h))[hit]})

    ddl = "term long, tbl string, id long, pos int" if positions else "term long, n long"
    return texts.filter("id is not null").select("tbl", "id", "text").mapInPandas(run, ddl)


def _collect_terms(df: DataFrame) -> np.ndarray:
    """Sorted hashes of the item side's terms; they grow with the items, never with the texts."""
    return np.sort(df.toPandas()["term"].to_numpy(np.int64))


def anchors(texts: DataFrame, win: DataFrame, whole: bool = True) -> DataFrame:
    """(item_id, start, print1, print2, chinese, term1, off1, term2, off2): each window's two rarest terms, of windows whose terms all occur.

    With whole=False, the two rarest terms that do occur of every window; the second is null where only one does.
    """
    vocab = win.select("term").distinct()
    n = _scan(texts, _collect_terms(vocab), positions=False).groupBy("term").agg(F.sum("n").alias("n"))
    rare = Window.partitionBy("item_id", "start").orderBy("n", "off")
    ranked = win.join(n, "term", "left" if whole else "inner").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(rare))
    pick = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c))).alias(f"{c}{k}")
    kept = [F.first(c).alias(c) for c in ("print1", "print2", "chinese")]
    return ranked.groupBy("item_id", "start").agg(F.min("n").alias("least"), *kept, *[pick(k, c) for k in (1, 2) for c in ("term", "off")]).filter("least > 0").drop("least")


def _numbered(anchor: DataFrame) -> DataFrame:
    """anchor, written, with w: the windows' dense numbers."""
    return materialise(assign_ids(anchor, ["item_id", "start"], "w").withColumn("w", F.col("w").cast("long")), "anchors")


def positional_index(texts: DataFrame, anchor: DataFrame) -> DataFrame:
    """(term, tbl, id, pos): the stored postings of all anchors over all texts."""
    terms = anchor.select(F.explode(F.array("term1", "term2")).alias("term")).filter("term is not null").distinct()
    return materialise(_scan(texts, _collect_terms(terms), positions=True), "postings")


def phrase_candidates(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """(tbl, id, w, at): texts that have both anchors of window w at the right distance; the phrase would begin at `at`."""
    one = index.join(_sized(anchor, 80), F.col("term") == F.col("term1")).filter(F.col("pos") >= F.col("off1"))
    one = one.select("w", "tbl", "id", (F.col("pos") - F.col("off1")).alias("at"), F.col("term2").alias("term"), (F.col("pos") - F.col("off1") + F.col("off2")).alias("pos"))
    return one.join(index, ["term", "tbl", "id", "pos"], "left_semi").select("tbl", "id", "w", "at")


MATCH = T.StructType([T.StructField("tbl", T.StringType()), T.StructField("id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("at", T.IntegerType())])


def phrase_matches(texts: DataFrame, anchor: DataFrame, candidates: DataFrame) -> DataFrame:
    """(tbl, id, item_id, start, at) of the candidates whose whole phrase is the same. Each text is cut into terms once."""
    # a candidate travels as one number: its window and its place
    asked = F.shiftleft(F.col("w"), 32).bitwiseOR(F.col("at").cast("long"))
    per = materialise(candidates.groupBy("tbl", "id").agg(F.collect_set(asked).alias("asked")), "asked")
    found = texts.select("tbl", "id", "text").join(_sized(per, 64, 8, "asked"), ["tbl", "id"])
    # the windows grow with the items, never with the texts
    held = texts.sparkSession.sparkContext.broadcast(anchor.select("w", "item_id", "start", "print1", "print2", "chinese").toPandas().sort_values("w").reset_index(drop=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = {c: held.value[c].to_numpy() for c in held.value}
        for b in batches:
            rows = []
            for tbl, i, text, asked in zip(b["tbl"], b["id"], b["text"], b["asked"]):
                if not isinstance(text, str):
                    continue
                packed = np.asarray(asked, np.int64)
                which, at = np.searchsorted(windows["w"], packed >> 32), packed & 0xFFFFFFFF
                for kind in (False, True):
                    own = windows["chinese"][which] == kind
                    if not own.any():
                        continue
                    h, n = _hash(han_terms(text) if kind else word_terms(text)), PHRASE_HAN - GRAM + 1 if kind else PHRASE_WORDS
                    if len(h) < n:
                        continue
                    one, two = _prints(h, n)
                    k, place = which[own], at[own]
                    k, place = k[place < len(one)], place[place < len(one)]
                    same = (one[place] == windows["print1"][k]) & (two[place] == windows["print2"][k])
                    rows += [(tbl, i, int(windows["item_id"][x]), int(windows["start"][x]), int(y)) for x, y in zip(k[same], place[same])]
            yield pd.DataFrame(rows, columns=MATCH.names)

    return found.mapInPandas(run, MATCH).distinct()


def leaks(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Exact phrase matches of items (item_id, text) in texts (tbl, id, text): (tbl, id, item_id, start, at).

    Null and empty texts or items, items shorter than a phrase, and null keys match nothing; repeated rows
    count once.
    """
    win = materialise(windows(items), "windows")
    anchor = _numbered(anchors(texts, win))
    index = positional_index(texts, anchor)
    return phrase_matches(texts, anchor, phrase_candidates(index, anchor))


@F.pandas_udf(T.LongType())
def _chain(hits: pd.Series) -> pd.Series:
    """The most hits (place, pos) of which both rise from one to the next."""
    out = []
    for x in hits:
        ends: list[int] = []
        for _, pos in sorted((h["place"], -h["pos"]) for h in x):
            k = bisect.bisect_left(ends, -pos)
            ends[k : k + 1] = [-pos]
        out.append(len(ends))
    return pd.Series(out, dtype="int64")


def near_leaks(texts: DataFrame, items: DataFrame, slop: int = 6, least: int = 4) -> DataFrame:
    """Proximity matches: (tbl, id, item_id, n_terms) of texts with `least` distinct anchors of an item in order, each within `slop` words of its place; and all exact matches.

    Every window has anchors, also those with terms that occur in no text. An edited passage with fewer than
    `least` anchors left is not found.
    """
    win = materialise(windows(items), "windows")
    anchor = _numbered(anchors(texts, win, whole=False))
    index = positional_index(texts, anchor)
    exact = phrase_matches(texts, anchor, phrase_candidates(index, anchor)).select("tbl", "id", "item_id", F.lit(True).alias("exact")).distinct()
    spot = lambda k: F.struct(F.col(f"term{k}").alias("term"), (F.col("start") + F.col(f"off{k}")).alias("place"))
    places = anchor.select("item_id", F.explode(F.array(spot(1), spot(2))).alias("x")).select("item_id", "x.*").filter("term is not null").distinct()
    hits = index.join(_sized(places, 40), "term").withColumn("shift", F.col("pos") - F.col("place"))
    slots = F.array(F.floor(F.col("shift") / (2 * slop)), F.floor((F.col("shift") + slop) / (2 * slop)) + F.lit(1 << 40))
    per = hits.select("tbl", "id", "item_id", "place", "pos", F.explode(slots).alias("slot")).groupBy("tbl", "id", "item_id", "slot").agg(F.collect_set(F.struct("place", "pos")).alias("hits"))
    most = per.withColumn("n", _chain(F.col("hits"))).groupBy("tbl", "id", "item_id").agg(F.max("n").alias("n_terms"))
    return most.join(exact, ["tbl", "id", "item_id"], "left").filter((F.col("n_terms") >= least) | F.col("exact")).drop("exact")
