"""Record-level operators: ids, limits, resume, sources, splits, samples, batches, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_IDS = 1_000_000  # finished ids that may be broadcast (8 bytes each, some 100 MB as a hash relation)


def assign_ids(df: DataFrame, order: list[str], name: str = "process_id") -> DataFrame:
    """df with dense ids from 1 in the given order.

    Rows are range-partitioned by the order and numbered inside their partition; the partitions' sizes, one row
    each, are summed up and joined. No task sees more than its own range.
    """
    from veriloom.session import materialise

    # range partitioning is done once and kept: its bounds come from a sample
    parted = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ids")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = parted.withColumn("_row", inside).join(F.broadcast(before.select("_part", "_before")), "_part")
    return numbered.withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def limit_by_id(df: DataFrame, n: int, name: str = "process_id") -> DataFrame:
    """The first n records by id; 0 is no limit."""
    return df if not n else df.filter(F.col(name) <= n)


def resume(df: DataFrame, done: DataFrame, name: str = "process_id") -> DataFrame:
    """Records whose id is not among the finished ones: a left-anti join, broadcast where the ids are few.

    A null id never counts as finished.
    """
    ids = done.select(name).filter(F.col(name).isNotNull()).distinct()
    small = ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    return df.join(F.broadcast(ids) if small else ids, name, "left_anti")


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of the named sources, with column source set to the name (whatever it was); columns match by name."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def shuffled(*keys: Column | str, seed: int = 0) -> Column:
    """A number to order by at random, the same at every run."""
    return F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(seed))


def md5_number(*parts: Column) -> Column:
    """A reproducible number below 2^32 that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def split(df: DataFrame, key: str, share: float = 0.1, most: int = 200, seed: int = 42) -> DataFrame:
    """df with column split: eval for min(int(share n), most) rows of a random order, else train. Exact sizes.

    The order is by md5 of key and seed, ties by key. Only the eval rows' border is found globally: the top `most`
    rows, taken per partition first.
    """
    n = min(int(share * df.count()), most)
    rank = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    head = df.select(F.col(key).alias("_k"), rank.alias("_r")).orderBy("_r", "_k").limit(n).select("_k").distinct().withColumn("_e", F.lit(True))
    return df.join(F.broadcast(head), F.col(key) == F.col("_k"), "left").withColumn("split", F.when(F.col("_e"), "eval").otherwise("train")).drop("_k", "_e")


def non_empty(*columns: str) -> Column:
    """Whether all columns hold text; null counts as empty."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.length(c) > 0, F.lit(False))
    return out


def has_keys(raw: str, *keys: str) -> Column:
    """Whether a JSON object has all keys at its top, null values included."""
    names = F.json_object_keys(raw)
    out = F.lit(True)
    for k in keys:
        out = out & F.coalesce(F.array_contains(names, k), F.lit(False))
    return out


def batches(df: DataFrame, size: int, id_column: str, drop_last: bool = False, first: int = 1) -> DataFrame:
    """df with batch_id: slices of `size` by a dense id from `first`; the last ragged one stays unless drop_last."""
    out = df.withColumn("batch_id", F.floor((F.col(id_column) - first) / size).cast("long"))
    if not drop_last:
        return out
    full = df.agg(F.floor((F.max(id_column) - first + 1) / size).alias("_full"))
    return out.join(F.broadcast(full), F.col("batch_id") < F.col("_full"), "left_semi")


def epochs(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """df repeated for n epochs, each with its own random order: columns epoch and shuffle_key."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("shuffle_key", shuffled(key, "epoch", seed=seed))


def first_batch(batched: DataFrame, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """The rows of batch 0; with most, the first of them in the order given."""
    out = batched.filter(F.col("batch_id") == 0)
    return out if most is None else out.orderBy(*(order or out.columns)).limit(most)


def appended(frames: list[DataFrame]) -> DataFrame:
    """The rows of the frames one after another, with column part: the frame's number. Columns match by name."""
    out = None
    for i, df in enumerate(frames):
        df = df.withColumn("part", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def concatenated(*arrays: Column) -> Column:
    """Arrays joined into one; a null array counts as empty."""
    return F.concat(*[F.coalesce(a, F.slice(F.array_repeat(F.get(a, F.lit(0)), 1), 1, 0)) for a in arrays])


def every(df: DataFrame, step: str, n: int) -> DataFrame:
    """The rows whose step is a multiple of n."""
    return df.filter(F.col(step) % n == 0)


def rank_seed(seed: int, rank: Column) -> Column:
    """The seed of a rank."""
    return F.lit(seed) + rank.cast("long") * 100_003  # fixed value: the distance of the ranks' seeds


def bernoulli(df: DataFrame, share: float, *keys: Column, seed: Column | int = 0) -> DataFrame:
    """Each row with a chance of `share`, the same at every run: md5 of keys and seed, as a number below 2^32, is below the share."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return df.filter(md5_number(*keys, seed.cast("string")) < int(share * 2**32))


def choose(options: list[str], *keys: Column, skip_first: Column | None = None) -> Column:
    """One of the options by md5 of the keys; where skip_first holds, not the first."""
    h = md5_number(*keys)
    array = F.array(*[F.lit(o) for o in options])
    whole = F.get(array, (h % len(options)).cast("int"))
    if skip_first is None:
        return whole
    return F.when(skip_first, F.get(array, (h % (len(options) - 1) + 1).cast("int"))).otherwise(whole)


def retained(checkpoints: DataFrame, group: str, at: str, most: int) -> DataFrame:
    """checkpoints with column keep: whether it is among the latest `most` of its group; of equals the greater other columns stay."""
    rest = sorted(c for c in checkpoints.columns if c not in (group, at))
    latest = Window.partitionBy(group).orderBy(F.desc(at), *[F.desc(c) for c in rest])
    return checkpoints.withColumn("keep", F.row_number().over(latest) <= most)


def prefixed(m: Column, prefix: str) -> Column:
    """The entries of a map whose keys have the prefix, without it."""
    return F.transform_keys(F.map_filter(m, lambda k, v: F.startswith(k, F.lit(prefix))), lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def merged(base: Column, over: Column) -> Column:
    """Two maps; the second one's values hold."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)
