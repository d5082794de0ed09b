"""Token ids of a whole corpus by a distinct-word table (problem 7).

A byte-level BPE never merges across the words that its pattern cuts, so a text's ids are those of its words one
after another. Texts repeat words far more often than they bring new ones:

1. Texts are put into blocks of about BLOCK_CHARS characters and cut into words in the JVM; a block keeps each
   of its words once.
2. The distinct words of all blocks are the word table; each is encoded once, whatever the number of texts.
3. The ids go back to the blocks by a join on the word. A word that every text has occurs once a block, not once a
   text, which takes the skew out of the join; AQE splits what remains.
   A block beyond twice its size, as of one row delivered very often, is dealt to parts, each with the block's words.
4. In each block the ids are put at the positions of the words, by one vectorised lookup for the whole block.

Decoding is a join of the ids with the vocabulary (id, piece), put together by position.

Vocabulary files are read from a path given as a parameter or in VERILOOM_TOKENIZERS, else from where the package
public_tokenizers lies; they must be there on all workers.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.session import materialise

BLOCK_CHARS = 4_000_000
DEFAULT = "byte_bpe_50k"

# Fixed value: the pattern that cuts texts into words, with white space as Unicode has it.
_WS = r"\p{IsWhite_Space}"
WORDS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?![^{_WS}])|{_WS}+"


def tokenizer_dir(path: str | None = None) -> str:
    """Folder of the vocabulary files."""
    if path or os.environ.get("VERILOOM_TOKENIZERS"):
        return path or os.environ["VERILOOM_TOKENIZERS"]
    try:
        import public_tokenizers

        return os.path.dirname(public_tokenizers.__file__)
    except ImportError:
        return "/opt/tokenizers"


@functools.lru_cache(maxsize=4)
def ranks(name: str, folder: str) -> dict[bytes, int]:
    """Vocabulary of a byte-level BPE: piece to id."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoding(name: str, folder: str):
    """The encoder of one word: no pattern is left to apply."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=r"[\s\S]+", mergeable_ranks=ranks(name, folder), special_tokens={})


@functools.lru_cache(maxsize=4)
def counter(name: str, folder: str):
    """A function that counts the tokens of one text."""
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks(name, folder), special_tokens={})
    return lambda text: len(enc.encode_ordinary(text))


def words(text: Column) -> Column:
    """The words of a text in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def word_table(distinct: DataFrame, name: str, folder: str) -> DataFrame:
    """(word, ids) of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return distinct.select("word").mapInArrow(run, "word string, ids array<int>")


def encode(df: DataFrame, text: str = "text", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """df with a column ids: the token ids of column `text`, without special tokens.

    Null and empty texts have the empty list. What looks like a special token is ordinary text. Rows stay as
    they are and as many; a column of df named ids is replaced. Lone surrogates cannot occur in Spark's strings.
    """
    folder = tokenizer_dir(folder)
    rest = [c for c in df.columns if c != "ids"]
    block, cut, part = (next(x for x in (name_ + "_" * k for k in range(len(rest) + 1)) if x not in rest) for name_ in ("_block", "_words", "_part"))
    base = df.select(*[F.col(f"`{c}`") for c in rest])
    body = F.col(f"`{text}`")
    chars = base.agg(F.sum(F.length(body))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    plain = [F.col(f"`{c}`") for c in rest if not isinstance(df.schema[c].dataType, T.MapType)]
    blocks = base.withColumn(block, F.pmod(F.xxhash64(*plain), F.lit(n)))
    parts = F.ceil(F.col("chars") / BLOCK_CHARS).cast("int")
    large = materialise(blocks.groupBy(F.col(block).alias("of")).agg(F.sum(F.length(body)).alias("chars")).filter(F.col("chars") > 2 * BLOCK_CHARS).select("of", parts.alias("parts")), "large")
    used = blocks.select(F.col(block).alias("of"), F.explode(F.array_distinct(words(body))).alias("word")).distinct()
    used = materialise(used, "words")
    told = used.join(word_table(used.select("word").distinct(), name, folder), "word").select("of", "word", "ids")
    if large.isEmpty():
        blocks, told = blocks.withColumn(part, F.lit(0)), told.withColumn("part", F.lit(0))
    else:
        blocks = blocks.join(large.withColumnRenamed("of", block).withColumnRenamed("parts", part), block, "left").withColumn(part, F.floor(F.rand(7) * F.coalesce(part, F.lit(1))).cast("int"))
        told = told.join(large, "of", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    # the texts are shuffled as they are and cut into words behind the shuffle, where they lie by block
    blocks = blocks.repartition(block, part).sortWithinPartitions(block, part).withColumn(cut, words(body))
    out = T.StructType([*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), True))])

    def place(texts: pa.Table, own: pa.Table) -> pa.Table:
        lists = texts.column(cut).combine_chunks()
        lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = lists.flatten()
        ids = own.column("ids").combine_chunks()
        size = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        first, values = np.cumsum(size) - size, ids.flatten().to_numpy(zero_copy_only=False)
        at = pc.index_in(flat, value_set=own.column("word").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        k = size[at]
        total = np.concatenate([[0], np.cumsum(k)])
        where = np.arange(total[-1]) - np.repeat(total[:-1] - first[at], k)
        result = pa.ListArray.from_arrays(pa.array(total[ends], pa.int32()), pa.array(values[where], pa.int32()))
        return pa.table([*[texts.column(c) for c in rest], result], names=[*rest, "ids"])

    return blocks.groupBy(block, part).cogroup(told.groupBy("of", "part")).applyInArrow(place, out)


def vocabulary(spark: SparkSession, name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """(token_id, piece) of a vocabulary: some 50,000 rows, as many as the file has."""
    v = ranks(name, tokenizer_dir(folder))
    return spark.createDataFrame(pd.DataFrame({"token_id": list(v.values()), "piece": [bytes(k) for k in v]}), "token_id int, piece binary")


def decode(df: DataFrame, key: str, ids: str = "ids", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """(key, text): the texts of token ids, by a join with the vocabulary. An empty list gives the empty text; null none."""
    pieces = df.filter(F.col(ids).isNotNull()).select(F.col(key).alias("_k"), F.posexplode_outer(ids).alias("pos", "token_id"))
    named = pieces.join(F.broadcast(vocabulary(df.sparkSession, name, folder)), "token_id", "left")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("hex")))), lambda x: x["hex"])
    return named.groupBy("_k").agg(F.decode(F.unhex(F.concat_ws("", joined)), "UTF-8").alias("text")).withColumnRenamed("_k", key)
