"""Texts cut at a field limit or in transfer (problem 5).

A text that ends as a sentence, a label, a boxed answer or an option does is whole. Any other is judged by
evidence, in bits, all of it counted over the whole corpus:

- word_bits: the final word against a trie of the corpus vocabulary. An unknown word that is a proper prefix of known
  words was cut in its middle.
- follow_bits: what the trie's counts say of a whole final word (in Chinese the longest known of its last 4, 2 and 1
  characters; commas, colons and numbers count as words): how much rarer sentences and lines end behind it than behind any
  word. Nearly none ends behind "if"; many do behind "fever", which speaks against a cut.
- length_bits: how many more different texts of the table (or of the source) end at just this length than at
  the lengths around.
- stop_bits: the weighed third. For a text whose earlier sentences have ends and whose last one has none, it is what
  the table's own texts say: how many whole ones there are to one such (not at a limit), beyond 8, up to 3 bits; where
  texts often end without a stop it speaks against a cut. Much speaks against one of a text without any
  sentence end, a list item or a heading, and a number with a point, which need evidence of their own; a broken
  character speaks for a cut, and so does an ellipsis.

A text is cut if the sum is above zero. The trie is a table of nodes (hash of the prefix, how often it is a word, how
often a longer word goes through it, how often a sentence or line ends behind it), built by pre-aggregated
groupings; final words look their nodes up by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import materialise

MIN_CHARS = 20  # shorter lengths are no limits
AROUND = 20  # lengths to either side
AT_LIMIT_BITS = 2.0  # length_bits of a text that is said to end at a limit
MIN_KNOWN = 3  # occurrences inside texts that make a word known
MIN_GRAM = 20  # and two or four Chinese characters
WORD_BITS = 7.0  # of an unknown proper prefix of known words; hardly one in a hundred final words of whole texts is one
STOP_BITS = {"unstopped": -5.0, "aside": -3.0, "number": -3.0, "marked": 3.0, "broken": 9.0}
USUAL_BITS, LEAST_BITS, MOST_BITS = 3.0, -5.0, 3.0  # of whole texts to one unclosed, and the bounds of what is beyond
SMALL_KEYS = 200_000  # looked-up nodes (8 bytes each) that may be broadcast
TAIL = 64  # characters looked at first; where a pattern may reach further back, the whole text is

# Blanks that may trail a text, marks that end a generation, sentence ends and what may close them.
_BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u200b\u200c\u200d\u2060\ufeff\u3000"
_END_MARK = r"(</?s?>?|<\|[a-z_]*\|?>?)"
_STOP = r"[.!?。！？]"
_CLOSER = r"""["'”’»」』）)\]】*_]"""
_PLACEHOLDER = r"(?iU)^[\W_\x{200c}\x{200d}]*+(n/?a|tbd|todo|null|none|nil|no answer|unknown|empty|无|暂无|待定)?[\W_\x{200c}\x{200d}]*+$"
_HEADING = r"(?m)^\h*#{1,6}(\h.*)?$"
_ASIDE = r"^\h*([-*•]|\d+[.)]|#{1,6})\h"
_BOLD = r"(^|[\s.。!?])\*\*[^*]+\*\*$"
_BOXED = r"^\h*(\*\*.*\*\*|\[.*\]|=>.*[)）]|[(（].*[)）])$|[:：]\h*[(（]?[A-N][)）]$"
_LATIN = r"[\p{L}&&[^\p{IsHan}]]"
_MARK = r"[,;:，；：、]"
_CLOSING = r"""(?:["'”’)\]]*+[.!?。！？\n](?!\p{N})|(?=[\s\S]))"""
_BODY = rf"(?:{_LATIN}++|\p{{IsHan}}++|\p{{N}}++|{_MARK})"
_TOKEN = _BODY + _CLOSING


def trimmed(text: Column) -> Column:
    """The text without trailing blanks and left-over end marks, however many."""
    t = F.rtrim(text, F.lit(_BLANKS))
    marked = lambda x: F.right(x, F.lit(20)).rlike(f"{_END_MARK}$")
    one = lambda x: F.when(marked(x), F.rtrim(F.concat(F.substring(x, F.lit(1), F.greatest(F.length(x) - 20, F.lit(0))), F.regexp_replace(F.right(x, F.lit(20)), f"{_END_MARK}$", "")), F.lit(_BLANKS))).otherwise(x)
    steps = F.sequence(F.lit(1), F.length(t) - F.length(F.replace(t, F.lit("<"), F.lit(""))))
    return F.when(marked(t), F.aggregate(steps, t, lambda x, _: one(x))).otherwise(t)


def is_empty(text: Column) -> Column:
    """Whether there is nothing but blanks, headings or a placeholder. A null text is empty."""
    body = F.when(text.contains("#"), F.regexp_replace(text, _HEADING, "")).otherwise(text)
    return text.isNull() | body.rlike(_PLACEHOLDER) | ~body.rlike(r"[\p{L}\p{N}]")


def _at_end(text: Column, tail: Column, pattern: str) -> Column:
    """What the end of the text matches; the pattern is tried on the tail and, if it fills that, on the whole text."""
    short = F.regexp_extract(tail, f"{pattern}$", 0)
    return F.when(F.length(short) < TAIL, short).otherwise(F.regexp_extract(text, f"{pattern}$", 0))


def endings(texts: DataFrame) -> DataFrame:
    """texts with columns t (trimmed text), line (its last line), tail, and ending: empty, whole, marked, broken, aside, number, unclosed or unstopped.

    Each step is a column of its own, so that no pattern is matched more than once a text.
    """
    df = texts.withColumn("t", trimmed(F.col("text"))).withColumn("empty", is_empty(F.col("text")))
    df = df.withColumn("line", F.substring_index("t", "\n", -1)).withColumn("tail", F.right("t", F.lit(TAIL)))
    t, line, tail = F.col("t"), F.col("line"), F.col("tail")
    # closers without a break may be any number, then the whole text is looked at
    ended = F.when(tail.rlike(f"^{_CLOSER}*$"), t).otherwise(tail)
    kind = (
        F.when(F.col("empty"), "empty")
        .when(t.endswith("\ufffd"), "broken")
        .when(t.endswith("…") | t.endswith("..."), "marked")
        .when(tail.rlike(r"\d\.$"), "number")
        .when(ended.rlike(f"{_STOP}{_CLOSER}*$"), "whole")
        .when(tail.rlike(r"[)）\]*]$") & (line.rlike(_BOXED) | line.rlike(_BOLD)), "whole")
        .when(tail.rlike(r"[:：]\h*[(（]?[A-N]$") | line.rlike(r"^\h*[(（]?[A-N][)）]?$"), "whole")
        .when(line.rlike(_ASIDE), "aside")
        .when(t.rlike(rf"[。！？]|[.!?]{_CLOSER}*\s"), "unclosed")
        .otherwise("unstopped")
    )
    return df.withColumn("ending", kind).drop("empty")


def last_tokens(t: Column, tail: Column) -> Column:
    """What a trimmed text ends with: a word as written and in lower case, a mark, a number, or the last 4, 2 and 1 of Chinese characters; an array, empty where it ends otherwise."""
    latin = _at_end(t, tail, rf"(?<!{_LATIN}){_LATIN}++")
    han = F.regexp_extract(tail, r"\p{IsHan}{1,4}+$", 0)
    mark = F.regexp_extract(tail, f"{_MARK}$", 0)
    grams = F.filter(F.array(*[F.when(F.length(han) >= k, F.right(han, F.lit(k))) for k in (4, 2, 1)]), lambda x: x.isNotNull())
    return F.when(F.length(latin) > 0, F.array_distinct(F.array(latin, F.lower(latin)))).when(F.length(han) > 0, grams).when(F.length(mark) > 0, F.array(mark)).when(tail.rlike(r"\p{N}$"), F.array(F.lit("0"))).otherwise(F.array().cast("array<string>"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n, closing) of all tokens inside the texts of column `text`: words as they are written, marks, numbers (all alike) and runs of 1, 2 and 4 Chinese characters.

    closing is how often a sentence or line ends behind it. An unclosed final word of a text is left out. Tokens
    are counted as they stand in the text first, so that only different ones are taken apart.
    """
    raw = texts.filter(F.col("text").isNotNull()).select(F.explode(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    body = F.regexp_extract("raw", f"^{_BODY}", 0)
    parts = raw.select(F.when(body.rlike(r"^\p{N}"), "0").otherwise(body).alias("body"), "n", (F.length("raw") > F.length(body)).alias("shut"))
    gram = lambda j: F.transform(F.filter(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda k: k <= j), lambda k: F.struct(F.substring("body", j - k + 1, k).alias("word"), (F.col("shut") & (j == F.length("body"))).alias("shut")))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("body")), gram))
    own = F.array(F.struct(F.col("body").alias("word"), F.col("shut").alias("shut")))
    rows = parts.select("n", F.explode(F.when(F.col("body").rlike(r"^\p{IsHan}"), grams).otherwise(own)).alias("x"))
    return rows.groupBy(F.col("x.word").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x.shut"), F.col("n")).otherwise(0)).alias("closing"))


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS else keys


def trie(words: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Nodes (key, as_word, below, closing) of the trie of words (word, n, closing); with asked (key), only those.

    key is the hash of a prefix. A word has a node for each of its letters, whatever their number; marks and
    Chinese characters have their own only.
    """
    node = lambda i: F.struct(F.xxhash64(F.substring("word", F.lit(1), i)).alias("key"), (i == F.length("word")).alias("ends"))
    first = F.when(F.col("word").rlike(f"^{_LATIN}"), F.lit(1)).otherwise(F.length("word"))
    rows = words.select("n", "closing", F.explode(F.transform(F.sequence(first, F.length("word")), node)).alias("x")).select("n", "closing", "x.key", "x.ends")
    if asked is not None:
        rows = rows.join(_small(asked), "key", "left_semi")
    own = lambda c: F.sum(F.when(F.col("ends"), F.col(c)).otherwise(0))
    return rows.groupBy("key").agg(own("n").alias("as_word"), F.sum(F.when(F.col("ends"), 0).otherwise(F.col("n"))).alias("below"), own("closing").alias("closing"))


def limits(sized: DataFrame, *group: str) -> DataFrame:
    """(group, n_chars, bits): how many more different texts (column h) have a length than have those around; lengths with none more are left out.

    One row a length and group: never many. A text is not evidence for itself.
    """
    by = sized.filter(F.col("n_chars") >= MIN_CHARS).groupBy(*group, "n_chars").agg(F.count_distinct("h").alias("n"))
    near = Window.partitionBy(*group).orderBy("n_chars").rangeBetween(-AROUND, AROUND)
    mean = (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * AROUND)
    return by.withColumn("bits", F.log2(F.col("n") / (mean + 1))).filter("bits > 0").select(*group, "n_chars", "bits")


def conventions(marked: DataFrame, lim: DataFrame) -> DataFrame:
    """(tbl, unclosed_bits): how much an unclosed end speaks for a cut in each table. One row a table."""
    off = marked.filter(F.col("ending").isin("whole", "unclosed")).join(lim.filter(F.col("bits") >= AT_LIMIT_BITS), ["tbl", "n_chars"], "left_anti")
    per = off.groupBy("tbl").agg(F.count_if(F.col("ending") == "whole").alias("w"), F.count_if(F.col("ending") == "unclosed").alias("u"))
    bits = F.log2((F.col("w") + 1) / (F.col("u") + 1)) - USUAL_BITS
    return per.select("tbl", F.greatest(F.lit(LEAST_BITS), F.least(F.lit(MOST_BITS), bits)).alias("unclosed_bits"))


def cut_texts(texts: DataFrame, vocab: DataFrame | None = None, evidence: bool = False) -> DataFrame:
    """Rows of texts (tbl, id, source, ...) without text, plus cut (null, or the kind of cut), at_limit and empty; with evidence, also word_bits, follow_bits, length_bits and stop_bits.

    Kinds: mid_char, marked (an ellipsis), mid_word (unknown proper prefix of known words), mid_number, and
    mid_sentence. Null, empty and placeholder texts are not cut; whole ones have no evidence. Repeated rows stay repeated; other columns stay,
    whatever their names, but for those this adds. The joins carry a row without its text; the text itself is
    never shuffled.
    """
    added = ("text", "cut", "at_limit", "empty", "word_bits", "follow_bits", "length_bits", "stop_bits")
    keep = [c for c in texts.columns if c not in added]
    by_source = "source" in keep
    own = texts.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "tbl", *(["source"] if by_source else []), "text")
    words = materialise(vocab if vocab is not None else vocabulary(own), "vocabulary")
    marked = endings(own).withColumn("n_chars", F.length("text")).withColumn("h", F.xxhash64("text"))
    judged = ~F.col("ending").isin("empty", "whole")
    bare = F.when(F.col("ending") == "marked", F.rtrim(F.col("t"), F.lit("…."))).otherwise(F.col("t"))
    marked = marked.withColumn("bare", bare).withColumn("tail", F.right("bare", F.lit(TAIL)))
    marked = marked.withColumn("tokens", F.when(judged, F.transform(last_tokens(F.col("bare"), F.col("tail")), lambda w: F.xxhash64(w)))).withColumn("latin", F.col("tail").rlike(f"{_LATIN}$"))
    marked = materialise(marked.drop("text", "t", "line", "tail", "bare"), "endings")
    asked = marked.filter(judged)
    keys = asked.select(F.explode("tokens").alias("key")).distinct()
    nodes = materialise(trie(words, materialise(keys, "asked")), "nodes")
    total = words.filter((F.length("word") == 1) | F.col("word").rlike(f"^{_LATIN}")).agg(F.sum("n").alias("n"), F.sum("closing").alias("c")).first()
    base = (total["c"] or 0) / max(1, total["n"] or 0)
    found = _small(nodes)
    for k in range(3):
        asked = asked.withColumn("_key", F.get("tokens", F.lit(k))).join(found.select(F.col("key").alias("_key"), F.struct("as_word", "below", "closing").alias(f"_n{k}")), "_key", "left").drop("_key")
    at = lambda k, c: F.coalesce(f"_n{k}.{c}", F.lit(0))
    known = lambda k, least: F.when(at(k, "as_word") >= least, F.col(f"_n{k}"))
    node = F.coalesce(*[known(k, F.when(F.size("tokens") == k + 1, MIN_KNOWN).otherwise(MIN_GRAM)) for k in range(3)], known(0, F.lit(MIN_KNOWN)))
    partial = F.col("latin") & (F.greatest(at(0, "as_word"), at(1, "as_word")) < MIN_KNOWN) & (F.greatest(at(0, "below"), at(1, "below")) >= MIN_KNOWN)
    asked = asked.withColumn("node", node).withColumn("word_bits", F.when(partial, WORD_BITS).otherwise(0.0))
    follow = F.log2((F.col("node.as_word") * F.lit(base) + 1) / (F.col("node.closing") + 1))
    asked = asked.withColumn("follow_bits", F.when(partial, 0.0).otherwise(F.coalesce(follow, F.lit(0.0))))
    lim = materialise(limits(marked, "tbl"), "limits")
    asked = asked.join(lim.withColumnRenamed("bits", "_t"), ["tbl", "n_chars"], "left").join(conventions(marked, lim), "tbl", "left")
    if by_source:
        asked = asked.join(limits(marked, "tbl", "source").withColumnRenamed("bits", "_s"), ["tbl", "source", "n_chars"], "left")
    asked = asked.withColumn("length_bits", F.greatest(F.coalesce("_t", F.lit(0.0)), F.coalesce("_s", F.lit(0.0)) if by_source else F.lit(0.0)))
    stop = F.coalesce("unclosed_bits", F.lit(0.0))
    for ending, bits in STOP_BITS.items():
        stop = F.when(F.col("ending") == ending, F.lit(bits)).otherwise(stop)
    asked = asked.withColumn("stop_bits", stop)
    ending = F.col("ending")
    kind = F.when(ending == "broken", "mid_char").when(ending == "marked", "marked").when(F.col("word_bits") > 0, "mid_word").when(ending == "number", "mid_number").otherwise("mid_sentence")
    bits = ["word_bits", "follow_bits", "length_bits", "stop_bits"] if evidence else []
    cut = F.when(F.col("word_bits") + F.col("follow_bits") + F.col("length_bits") + F.col("stop_bits") > 0, kind)
    told = asked.select("row", cut.alias("cut"), (F.col("length_bits") >= AT_LIMIT_BITS).alias("at_limit"), F.lit(False).alias("empty"), *bits)
    rest = marked.filter(~judged).select("row", F.lit(None).cast("string").alias("cut"), F.lit(False).alias("at_limit"), (ending == "empty").alias("empty"), *[F.lit(None).cast("double").alias(e) for e in bits])
    return rest.unionByName(told).select("row.*", "cut", "at_limit", "empty", *bits)


def cut_rates(cuts: DataFrame) -> DataFrame:
    """How often each source of each table cuts: (tbl, source, n_texts, n_cut, n_at_limit, share)."""
    return cuts.groupBy("tbl", "source").agg(F.count("*").alias("n_texts"), F.count("cut").alias("n_cut"), F.count(F.when(F.col("at_limit") & F.col("cut").isNotNull(), 1)).alias("n_at_limit")).withColumn("share", F.col("n_cut") / F.col("n_texts"))
