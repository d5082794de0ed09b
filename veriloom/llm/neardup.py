"""Near-duplicate texts by T-occurrence search over inverted lists (problem 2).

Two texts are linked if they share at least NUM/DEN of the distinct words that both have together, that is, if at
least T = ceil(NUM (|x| + |y|) / (NUM + DEN)) of their words are common. DivideSkip finds them: the inverted lists
of a text's words are divided into L long ones (its most frequent words) and short ones; the short ones are merged,
texts that occur T - L times in them are candidates, and are probed in the long ones by binary search.

L is T - 1, the most that leaves every link a common short word. Where lists are spread over a cluster by word, any
smaller L needs occurrences counted across shards, so that every pair with one common short word would travel;
with L = T - 1 one occurrence makes a candidate, no pair leaves a shard but those whose bounds reach T, and of the
lists some three in ten are merged: those of the rarest words.

How it is spread over a cluster:

1. Word counts over all texts. The usual words, those in one of USUAL texts or more, are numbered by count and go
   to all workers; there are never more than MOST_USUAL (6 MB). All other words come before them, in the order of
   their 64-bit hashes, as which words travel. Any total order gives the right result, this one short lists.
2. Equal word sets are one class with one representative; copies add nothing to the lists.
3. Short lists are sharded by word. A shard holds its words' lists, longest-text order inside a list, and of each
   text the size and a bitmap of BITS hashed words. A shard of more than SHARD_POSTINGS postings is split into
   blocks and compared block by block, so that no task holds an unbounded list.
4. In a shard the lists are merged: each text as a query is run against the texts below it in order (size, id),
   within the sizes that T allows; the places of the common word in both texts and the bitmaps bound the overlap
   from above, and pairs whose bound is below T go no further. Nothing of this is shuffled; only pairs that
   may reach T leave a task.
5. Long lists are stored by blocks of LIST_TEXTS texts: of each word the ascending numbers of the block's texts that
   have it (all words of a text, since the merge has seen its short lists in one shard only). A candidate takes its
   query's words to the block of the other text, and each word's list is probed for that text by binary search.
   The candidates of a block are dealt to cells of CELL_PAIRS, so that a text near to very many others is
   many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veriloom.session import materialise

NUM, DEN = 7, 10  # similarity of links
USUAL, MOST_USUAL = 2000, 500_000
BITS = 256
SHARD_POSTINGS = 400_000
TEXTS_PER_SHARD = 10_000
CHUNK = 1_000_000  # pairs looked at at once
LIST_TEXTS = 10_000  # texts of a block of long lists
CELL_PAIRS = 100_000  # candidates probed in one task
PROBES = 4_000_000  # probes at once
COPIES = 2000  # members of a class that are told out in one piece

_WORD = re.compile(r"[^\W_一-鿿㐀-䶿]+|[一-鿿㐀-䶿]+")
_HAN = re.compile(r"[一-鿿㐀-䶿]")


def word_set(text: str) -> set[str]:
    """Distinct words in lower case; of Chinese runs each two neighbouring characters (a lone one is itself)."""
    out: set[str] = set()
    for w in _WORD.findall(text.lower()):
        if _HAN.match(w):
            out.update(w[i : i + 2] for i in range(max(1, len(w) - 1)))
        else:
            out.add(w)
    return out


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all texts' distinct words one after another, number of words of each text)."""
    sets = [word_set(t) if t else set() for t in texts]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = [w for s in sets for w in s]
    if not flat:
        return np.empty(0, np.uint64), sizes
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    return pd.util.hash_array(np.asarray(uniques, dtype=object), categorize=False)[codes], sizes


def _need(total: np.ndarray) -> np.ndarray:
    """T for two sizes of that sum."""
    return -(-NUM * total // (NUM + DEN))


def usual_words(texts: DataFrame) -> np.ndarray:
    """Hashes of the words in one of USUAL texts or more, rarest first; at most MOST_USUAL, as counts add up to all words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, sizes = _hashes([t if isinstance(t, str) else None for t in b["text"]])
            u, n = np.unique(h, return_counts=True)
            yield pd.DataFrame({"word": u.view(np.int64), "n": n, "all": False})
            yield pd.DataFrame({"word": [0], "n": [int((sizes > 0).sum())], "all": [True]})

    counts = texts.select("text").mapInPandas(count, "word long, n long, all boolean").groupBy("all", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "words")
    sums = counts.agg(F.sum(F.when(F.col("all"), F.col("n"))).alias("texts"), F.sum(F.when(~F.col("all"), F.col("n"))).alias("words")).first()
    least = max((sums["texts"] or 0) / USUAL, (sums["words"] or 0) / MOST_USUAL)
    rows = counts.filter(~F.col("all") & (F.col("n") >= least)).select("word", "n").toPandas()
    rows = rows.sort_values(["n", "word"])
    return rows["word"].to_numpy(np.int64).view(np.uint64)


# --- a text's words in the global order: rare ones by hash, then usual ones by number ----------------------


class Order:
    """The total order of words: hashes of usual words with their numbers."""

    def __init__(self, usual: np.ndarray):
        by = np.argsort(usual)
        self.keys, self.rank = usual[by], by.astype(np.int64)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Sortable places: negative for rare words, the number for usual ones."""
        if not len(self.keys):
            return (h >> np.uint64(1)).astype(np.int64) - np.int64(2**63 - 1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.rank[at], (h >> np.uint64(1)).astype(np.int64) - np.int64(2**63 - 1))


def _pack(places: np.ndarray) -> bytes:
    """Sorted places as bytes: the number of rare words, them in 8 bytes each, the usual ones in 4."""
    k = int(np.searchsorted(places, 0))
    return np.uint32(k).tobytes() + places[:k].tobytes() + places[k:].astype(np.uint32).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    k = int(np.frombuffer(b, np.uint32, 1)[0])
    return np.concatenate([np.frombuffer(b, np.int64, k, 4), np.frombuffer(b, np.uint32, -1, 4 + 8 * k).astype(np.int64)])


def encode(texts: DataFrame, order: Order) -> DataFrame:
    """(tbl, id, cls, words) of the texts with any word: class key and packed words."""
    held = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o = held.value
        for b in batches:
            h, sizes = _hashes([t if isinstance(t, str) else None for t in b["text"]])
            places = o.place(h)
            ends = np.cumsum(sizes)
            packed = [_pack(np.sort(places[e - n : e])) if n else None for e, n in zip(ends, sizes)]
            out = pd.DataFrame({"tbl": b["tbl"], "id": b["id"], "words": packed})
            out = out[out["words"].notna()]
            out["cls"] = [hashlib.blake2b(w, digest_size=16).digest() for w in out["words"]]
            yield out[["tbl", "id", "cls", "words"]]

    return texts.select("tbl", "id", "text").mapInPandas(run, "tbl string, id long, cls binary, words binary")


# --- short lists, sharded by word --------------------------------------------------------------------------


def _blob(ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, doc: np.ndarray, code: np.ndarray, pos: np.ndarray) -> bytes:
    return b"".join([np.array([len(ids), len(doc)], np.uint32).tobytes(), *[x.tobytes() for x in (ids, sizes, bits, doc, code, pos)]])


def _unblob(b: bytes) -> list[np.ndarray]:
    n, m = map(int, np.frombuffer(b, np.uint32, 2))
    out, at = [], 8
    for kind, k in ((np.int64, n), (np.uint32, n), (np.uint64, n * BITS // 64), (np.uint32, m), (np.uint32, m), (np.uint32, m)):
        out.append(np.frombuffer(b, kind, k, at))
        at += k * np.dtype(kind).itemsize
    out[2] = out[2].reshape(n, BITS // 64)
    return out


def short_lists(classes: DataFrame, shards: int) -> DataFrame:
    """(tbl, shard, n, blob): postings of the classes' short lists, packed by batch and shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tbl, g in b.groupby("tbl"):
                words = [_unpack(w) for w in g["words"]]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                flat = np.concatenate(words)
                doc = np.repeat(np.arange(len(words)), sizes)
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                mixed = flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                bit = (mixed >> np.uint64(56)).astype(np.int64) % BITS
                bits = np.zeros((len(words), BITS // 64), np.uint64)
                np.bitwise_or.at(bits, (doc, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
                keep = pos < (sizes - -(-NUM * sizes // DEN) + 1)[doc]
                doc, pos, code = doc[keep], pos[keep], flat[keep]
                code = np.where(code >= 0, code, code & 0x7FFFFFFF | 0x80000000).astype(np.uint32)
                shard = ((code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % shards
                by = np.lexsort((pos, doc, shard))
                doc, pos, code, shard = doc[by], pos[by], code[by], shard[by]
                cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
                ids = g["rep"].to_numpy(np.int64)
                rows = []
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    d, local = np.unique(doc[lo:hi], return_inverse=True)
                    rows.append((tbl, int(shard[lo]), hi - lo, _blob(ids[d], sizes[d].astype(np.uint32), bits[d], local.astype(np.uint32), code[lo:hi], pos[lo:hi].astype(np.uint32))))
                yield pd.DataFrame(rows, columns=["tbl", "shard", "n", "blob"])

    return classes.select("tbl", "rep", "words").mapInPandas(run, "tbl string, shard long, n long, blob binary")


def _merge(blobs: list[bytes], blocks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (ids of the larger texts, ids of the smaller ones) of a cell's merged lists."""
    parts = [_unblob(b) for b in blobs]
    first = np.cumsum([0] + [len(p[0]) for p in parts])
    ids, size, bits = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2))
    block = np.repeat(np.array(blocks), np.diff(first))
    size = size.astype(np.int64)
    doc = np.concatenate([p[3] + np.int64(f) for p, f in zip(parts, first)])
    code, pos = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (4, 5))
    by = np.lexsort((ids, size))  # texts in order (size, id); below, texts are their places in it
    place = np.empty(len(ids), np.int64)
    place[by] = np.arange(len(ids))
    ids, size, bits, block, doc = ids[by], size[by], bits[by], block[by], place[doc]
    two = block.min() != block.max()
    inside = pos < (size - _need(2 * size) + 1)[doc]
    key = code << 32 | doc
    at = np.argsort(key[inside], kind="stable")
    keys, y_of, y_pos = key[inside][at], doc[inside][at], pos[inside][at]
    least = np.searchsorted(size, -(-NUM * size // DEN))  # first text large enough for each text
    lo = np.searchsorted(keys, code << 32 | least[doc])
    hi = np.searchsorted(keys, key)
    n = np.maximum(hi - lo, 0)
    total = np.cumsum(n)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + CHUNK, "right")))
        k = n[start:end]
        q = np.repeat(np.arange(start, end), k)
        j = np.arange(len(q)) + np.repeat(lo[start:end] - (np.cumsum(k) - k), k)
        x, y = doc[q], y_of[j]
        sx, sy = size[x], size[y]
        need = _need(sx + sy)
        ok = 1 + np.minimum(sx - pos[q] - 1, sy - y_pos[j] - 1) >= need
        if two:
            ok &= block[x] != block[y]
        x, y, most = x[ok], y[ok], (sx + sy - 2 * need)[ok]
        ok = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= most
        pair = np.unique(x[ok] << 32 | y[ok])
        yield ids[pair >> 32], ids[pair & 0xFFFFFFFF]
        start = end


def candidates(lists: DataFrame) -> DataFrame:
    """Distinct pairs (tbl, x, y) of representatives that may be linked."""
    load = lists.groupBy("tbl", "shard").agg(F.ceil(F.sum("n") / SHARD_POSTINGS).alias("blocks"))
    placed = lists.join(load, ["tbl", "shard"]).withColumn("block", F.pmod(F.xxhash64("blob"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = placed.select("tbl", "shard", "block", "blob", other).select("tbl", "shard", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "blob")

    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        if key[2] != key[3] and cell["block"].nunique() < 2:
            found = []
        else:
            found = list(_merge(list(cell["blob"]), list(cell["block"])))
        x = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        y = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        return pd.DataFrame({"tbl": key[0], "x": np.maximum(x, y), "y": np.minimum(x, y)}).drop_duplicates()

    return cells.groupBy("tbl", "shard", "a", "b").applyInPandas(run, "tbl string, x long, y long").distinct()


# --- long lists, by blocks of texts ------------------------------------------------------------------------


def _block(rep: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(rep), F.lit(blocks)).cast("int")


def long_lists(classes: DataFrame, blocks: int) -> DataFrame:
    """(tbl, block, texts, words, ends, numbers): the inverted lists of each block of classes, packed.

    texts are the block's representatives in order; the list of the k-th word (in order) is what numbers holds
    before ends[k]: ascending places in texts.
    """

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rep")
        lists = [_unpack(w) for w in b["words"]]
        number = np.repeat(np.arange(len(lists), dtype=np.int64), [len(x) for x in lists])
        flat = np.concatenate(lists)
        by = np.lexsort((number, flat))
        words, count = np.unique(flat, return_counts=True)
        return pd.DataFrame({"tbl": [key[0]], "block": [key[1]], "texts": [b["rep"].to_numpy(np.int64).tobytes()], "words": [words.tobytes()], "ends": [np.cumsum(count).astype(np.int64).tobytes()], "numbers": [number[by].astype(np.uint32).tobytes()]})

    rows = classes.select("tbl", _block("rep", blocks).alias("block"), "rep", "words")
    return rows.groupBy("tbl", "block").applyInPandas(run, "tbl string, block int, texts binary, words binary, ends binary, numbers binary")


def probe(lists: tuple[np.ndarray, ...], queries: list[np.ndarray], texts: np.ndarray) -> np.ndarray:
    """In how many lists (texts, words, ends, numbers) of each query's words its text is found, by binary search."""
    ids, words, ends, numbers = lists
    out = np.zeros(len(queries), np.int64)
    place = np.searchsorted(ids, texts)
    keys = np.repeat(np.arange(len(words), dtype=np.int64), np.diff(ends, prepend=0)) << 32 | numbers.astype(np.int64)
    size = np.fromiter(map(len, queries), np.int64, len(queries))
    total, start = np.cumsum(size), 0
    while start < len(queries):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PROBES, "right")))
        flat = np.concatenate(queries[start:end])
        of = np.repeat(np.arange(start, end), size[start:end])
        which = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        here = words[which] == flat
        wanted = which[here] << 32 | place[of[here]]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out[start:end] = np.bincount(of[here][keys[at] == wanted] - start, minlength=end - start)
        start = end
    return out


def probed(pairs: DataFrame, classes: DataFrame, blocks: int) -> DataFrame:
    """Those of the candidates (tbl, x, y) that are linked."""
    stored = long_lists(classes, blocks)
    queries = classes.select("tbl", F.col("rep").alias("x"), F.col("words").alias("asked"))
    put = materialise(pairs.withColumn("block", _block("y", blocks)), "candidates")
    cells = put.groupBy("tbl", "block").agg(F.ceil(F.count("*") / CELL_PAIRS).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("x", "y"), F.col("cells")).cast("int")
    asked = put.join(cells, ["tbl", "block"]).withColumn("cell", cell).drop("cells").join(queries, ["tbl", "x"])
    held = stored.join(cells, ["tbl", "block"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))

    def run(c: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        if not len(c):
            return c[["tbl", "x", "y"]]
        row = lists.iloc[0]
        packed = tuple(np.frombuffer(row[k], kind) for k, kind in (("texts", np.int64), ("words", np.int64), ("ends", np.int64), ("numbers", np.uint32)))
        codes, names = pd.factorize(c["x"])
        first = np.unique(codes, return_index=True)[1]
        own = [_unpack(w) for w in c["asked"].iloc[first]]
        found = probe(packed, [own[k] for k in codes], c["y"].to_numpy(np.int64))
        # a text's number of words: in how many lists it stands
        size = np.bincount(packed[3], minlength=len(packed[0]))
        sizes = np.fromiter(map(len, own), np.int64, len(own))[codes] + size[np.searchsorted(packed[0], c["y"].to_numpy(np.int64))]
        return c[["tbl", "x", "y"]][found >= _need(sizes)]

    return asked.groupBy("tbl", "block", "cell").cogroup(held.groupBy("tbl", "block", "cell")).applyInPandas(run, "tbl string, x long, y long")


def links(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of texts (tbl, id, text): members (tbl, id, rep), and linked representatives (tbl, x, y).

    Texts of different tables are not compared. Null texts, and texts without any word, are in no class. A
    repeated row counts once. Every link between texts is one between their representatives; members of a class
    are alike among themselves.
    """
    encoded = materialise(encode(texts, Order(usual_words(texts))), "encoded")
    classes = materialise(encoded.groupBy("tbl", "cls").agg(F.min("id").alias("rep"), F.first("words").alias("words")), "classes")
    members = encoded.select("tbl", "cls", "id").distinct().join(classes.select("tbl", "cls", "rep"), ["tbl", "cls"]).select("tbl", "id", "rep")
    n = classes.count()
    lists = materialise(short_lists(classes, max(12, n // TEXTS_PER_SHARD)), "lists")
    pairs = probed(candidates(lists), classes, max(1, n // LIST_TEXTS))
    return members, pairs


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: the links of representatives and classes told out for all their members.

    Classes of many copies are told out in pieces of COPIES members, so that none is one task.
    """
    size = members.groupBy("tbl", "rep").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts"))
    held = members.join(size.filter("parts > 1"), ["tbl", "rep"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = materialise(held.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "members")
    large = held.filter("parts > 1").select("tbl", "rep", "parts").distinct()
    each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))

    def side(df: DataFrame, rep: str, member: str) -> DataFrame:
        parts = df.join(large.withColumnRenamed("rep", rep), ["tbl", rep], "left").withColumn("part", each).drop("parts")
        return parts.join(held.select("tbl", F.col("rep").alias(rep), "part", F.col("id").alias(member)), ["tbl", rep, "part"]).drop("part")

    across = side(side(pairs.select("tbl", "x", "y"), "x", "i"), "y", "j")
    one = held.select("tbl", F.col("rep").alias("r"), F.col("part").alias("p"), each.alias("q"), F.col("id").alias("i"))
    other = held.select("tbl", F.col("rep").alias("r"), each.alias("p"), F.col("part").alias("q"), F.col("id").alias("j"))
    within = one.join(other, ["tbl", "r", "p", "q"]).filter(F.col("i") < F.col("j"))
    return across.select("tbl", F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).unionByName(within.select("tbl", F.col("i").alias("id_a"), F.col("j").alias("id_b")))


def _stated(edges: DataFrame) -> tuple[DataFrame, dict]:
    """(edges, written; their number and the sum of their hashes)."""
    seen = Observation()
    both = {"n": F.count(F.lit(1)), "sum": F.coalesce(F.sum(F.xxhash64("tbl", "u", "v").cast("decimal(38,0)")), F.lit(0))}
    out = materialise(edges.observe(seen, *[x.alias(k) for k, x in both.items()]), "links")
    return out, seen.get


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tbl, id, group_id): connected groups of linked texts, named by their smallest id.

    Large-star and small-star rounds in turn: every vertex hangs its larger neighbours, then all its smaller
    ones, on the smallest id it sees; links only ever get fewer or shorter, whatever the size of a group. Each
    round is a shuffle of the remaining links, written to the shared folder; they end when nothing changes, as they must.
    """
    edges, now = _stated(pairs.select("tbl", F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct())
    was = None
    while now != was:
        both = edges.unionByName(edges.select("tbl", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("tbl", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(low, ["tbl", "u"]).select("tbl", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("tbl", "u").agg(F.min("v").alias("m"))
        hung = large.join(least, ["tbl", "u"])
        small = hung.filter("v <> m").select("tbl", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("tbl", "u", F.col("m").alias("v"))).filter("u <> v").distinct()
        was = now
        edges, now = _stated(small)
    root = edges.select("tbl", F.col("u").alias("rep"), F.col("v").alias("_root"))
    return members.join(root, ["tbl", "rep"], "left").select("tbl", "id", F.coalesce("_root", "rep").alias("group_id"))
