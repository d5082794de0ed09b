"""Mixing sources to target shares of tokens (problem 8).

1. Each source gets want = share x total tokens, with the shares of the sources that have any text scaled to
   one. The default total is the largest at which no source would need more than its capped repeats, so that
   the shares are met by all; a larger total may be asked for, then short sources give all they may and the rest
   is filled up by the others in proportion.
2. The texts of a source have a random order (a hash of seed and key) and a place in tokens in it. The places
   come from sums over racks of hash buckets, over the buckets of a rack, and inside each bucket, so that a source that
   holds a third of all rows is never ordered in one task. A source is repeated by whole passes over its
   order, the last pass being cut where want is reached, to within half a text.
3. The sequence of a source is cut into blocks of BLOCK_TOKENS; of more, where there would be over most_blocks (a
   parameter): quotas and shares are as exact then, only neighbours stay together in larger pieces. A splitting tree deals the blocks out to the
   shards: at each node the left half draws its blocks from the node's, multivariate-hypergeometric, the right
   half has the rest, down to the leaves. Every leaf walks its own path, with the draws of a node seeded by the
   node; nothing but the path's counts (one a source) is held, and the leaves' quotas add up exactly.
4. A leaf's quota of a source is a range of the source's permuted blocks (a keyed permutation, computed, not
   stored); ranges of different leaves are disjoint. Blocks join texts by (source, block); inside a shard the
   texts are shuffled by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import materialise

BLOCK_TOKENS = 4_096
MOST_BLOCKS = 500_000_000  # beyond, blocks are larger; the draws take no more than twice as many
SHARD_TOKENS = 1_000_000
BUCKET_ROWS = 5_000
RACK = 10_000  # buckets that are summed up in one task, and then racks of them


@dataclass(frozen=True)
class Share:
    """What is wanted of a source; all in tokens."""

    source: str
    target: float
    max_repeats: int
    available: int
    want: float


def shares(available: dict[str, int], plan: list[tuple[str, float, int]], total: float | None = None) -> list[Share]:
    """What each source of the plan gives. Sources without tokens give nothing; their share falls to the others."""
    have = [(s, float(t), int(r), available.get(s, 0)) for s, t, r in plan if s is not None and available.get(s, 0) > 0 and (t or 0) > 0 and (r or 0) > 0]
    if not have:
        return []
    whole = sum(t for _, t, _, _ in have)
    if total is None:
        total = min(r * a * whole / t for _, t, r, a in have)
    want: dict[str, float] = {}
    open_, left = list(have), float(total)
    while open_:
        scale = left / sum(t for _, t, _, _ in open_)
        full = [x for x in open_ if scale * x[1] > x[2] * x[3] * (1 + 1e-12)]
        if not full:
            want |= {x[0]: scale * x[1] for x in open_}
            break
        for x in full:
            want[x[0]] = float(x[2] * x[3])
            left -= want[x[0]]
        open_ = [x for x in open_ if x[0] not in want]
    return [Share(s, t, r, a, want[s]) for s, t, r, a in sorted(have)]


def places(texts: DataFrame, seed: int, n_rows: int) -> DataFrame:
    """texts (key, source, n_tokens) plus start: where each begins in its source's random order, in tokens."""
    n = max(1, -(-n_rows // BUCKET_ROWS))
    h = texts.withColumn("_h", F.xxhash64(F.lit(seed), "key", "source")).withColumn("_bucket", F.pmod(F.shiftright("_h", 20), F.lit(n)))
    so_far = lambda by, at: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bucket = materialise(h.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_n")).withColumn("_rack", F.floor(F.col("_bucket") / RACK)), "buckets")
    rack = bucket.groupBy("source", "_rack").agg(F.sum("_n").alias("_n")).select("source", "_rack", so_far(["source"], "_rack").alias("_before"))
    inner = bucket.select("source", "_rack", "_bucket", so_far(["source", "_rack"], "_bucket").alias("_within"))
    base = inner.join(rack, ["source", "_rack"]).select("source", "_bucket", (F.col("_before") + F.col("_within")).alias("_base"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", "key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    own = h.withColumn("_own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(base, ["source", "_bucket"]).select("key", "source", "n_tokens", (F.col("_base") + F.col("_own")).alias("start"))


def permute(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A keyed permutation of 0 .. n-1 at k: four Feistel rounds on the next even number of bits, walked until inside."""
    if n <= 1:
        return k.astype(np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 2**63, 4, dtype=np.uint64)
    out, todo = k.astype(np.uint64), np.ones(len(k), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for key in keys:
                f = (right + np.uint64(1)) * (key | np.uint64(1))
                f ^= f >> np.uint64(31)
                left, right = right, left ^ (f * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask
        out[todo] = left << np.uint64(half) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def quota(blocks: np.ndarray, shard: int, n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of a shard's blocks of each source, by its path through the splitting tree."""
    total, lo, hi = int(blocks.sum()), 0, n_shards
    colors, first = blocks.astype(np.int64), np.zeros(len(blocks), np.int64)
    edge = lambda i: i * total // n_shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(colors, edge(mid) - edge(lo), method="marginals")
        if shard < mid:
            colors, hi = left, mid
        else:
            colors, first, lo = colors - left, first + left, mid
    return first, colors


def deal(spark, wanted: list[Share], n_shards: int, seed: int, block_tokens: int) -> DataFrame:
    """(source, block, shard) of all blocks; every leaf finds its own."""
    names = [s.source for s in wanted]
    blocks = np.array([max(1, int(np.ceil(s.want / block_tokens))) for s in wanted], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                first, count = quota(blocks, int(shard), n_shards, seed)
                for i, (f, c) in enumerate(zip(first, count)):
                    if c:
                        yield pd.DataFrame({"source": names[i], "block": permute(np.arange(f, f + c), int(blocks[i]), seed * 1009 + i), "shard": int(shard)})

    return spark.range(n_shards).mapInPandas(run, "source string, block long, shard long")


def mixture(texts: DataFrame, plan: DataFrame, total: float | None = None, seed: int = 17, shard_tokens: int = SHARD_TOKENS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The mixture of texts (key, source, n_tokens) by plan (source, target_share, max_repeats).

    (shard, pos, source, key, repeat, n_tokens) has one row for each use of a text, repeat counting from 0 below
    max_repeats; see report for the shares. Texts whose source is null or not in
    the plan, and sources with a null or no share, are not used; a plan that names a source twice is wrong and
    raises. The plan comes to the driver: it has one row a source. Texts without tokens count as having none.
    """
    spark = texts.sparkSession
    rules = [(r["source"], r["target_share"], r["max_repeats"]) for r in plan.select("source", "target_share", "max_repeats").collect()]
    if len({s for s, _, _ in rules}) < len(rules):
        raise ValueError("the plan names a source twice")
    sized = materialise(texts.select("key", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).filter(F.col("source").isin([s for s, _, _ in rules if s])), "sized")
    per = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()}
    wanted = shares({s: r["n"] for s, r in per.items()}, rules, total)
    whole = sum(s.want for s in wanted)
    n_shards, block_tokens = max(1, round(whole / shard_tokens)), max(BLOCK_TOKENS, int(whole // most_blocks))
    told = spark.createDataFrame([(s.source, s.available, s.want) for s in wanted], "source string, available long, want double")
    placed = places(sized, seed, sum(r["rows"] for r in per.values())).join(F.broadcast(told), "source")
    # pass c takes a text if the middle of its place lies before want
    passes = F.ceil((F.col("want") - F.col("start") - F.col("n_tokens") / 2) / F.col("available"))
    used = placed.withColumn("_passes", F.when((F.col("n_tokens") > 0), passes).otherwise(F.ceil((F.col("want") - F.col("start")) / F.col("available")))).filter("_passes > 0")
    used = used.withColumn("repeat", F.explode(F.sequence(F.lit(0), (F.col("_passes") - 1).cast("int"))))
    last = F.ceil(F.col("want") / block_tokens) - 1
    used = used.withColumn("block", F.least(last, F.floor((F.col("repeat") * F.col("available") + F.col("start")) / block_tokens)).cast("long"))
    dealt = used.join(deal(spark, wanted, n_shards, seed, block_tokens), ["source", "block"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "key", "repeat"), "source", "key", "repeat")
    mixed = dealt.withColumn("pos", F.row_number().over(order) - 1).select("shard", "pos", "source", "key", "repeat", "n_tokens")
    return mixed


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Actual shares: (source, target_share, max_repeats, n_rows, n_texts, most_repeats, n_tokens, actual_share)."""
    per = mixed.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("repeat") == 0).alias("n_texts"), (F.max("repeat") + 1).alias("most_repeats"), F.sum("n_tokens").alias("n_tokens"))
    out = plan.select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(0, ["n_rows", "n_texts", "most_repeats", "n_tokens"])
    return out.withColumn("actual_share", F.try_divide("n_tokens", F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))))
