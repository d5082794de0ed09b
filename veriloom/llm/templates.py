"""Answers that only decline, by templates that recur across unrelated prompts (part of problem 3).

Openings of answers (their first sentences) are clustered by MinHash: BANDS bands of ROWS hashes over shingles of
five words give candidates, of which each is verified at SIMILAR and the links are connected. Two openings at 0.8 meet
in no band with a chance of 6e-5, at 0.85 of 3e-7; bands of fewer hashes miss less, but make candidates of all pairs of openings
that have half a template in common. A sentence belongs to up to three templates: its cluster (or itself), its head and its tail, the
first and last five words; the latter hold sentences together in which a name varies.

What an answer says to its prompt varies with the prompt: its sentences are dealt anew each time. What declines
does not: the same few sentences are the whole answer to unrelated prompts. So, with n prompts of a template:

1. Seeds: templates whose most frequent whole answer (set of templates) makes SEED_SHARE of their prompts.
2. A template is closed in an answer all of whose other sentences are known. The share of closed prompts,
   (closed + A x prior) / (n + A), makes it known at CLOSED_SHARE. This is repeated until nothing is added.
3. Any short answer may recur ("The correct answer is option B."). Refusals are interchangeable: they also stand
   beside each other. A template must be closed in LEAST_COMPANY different whole answers, or be worded as a refusal.
   This is repeated, dropping templates, until nothing changes.

Both loops are monotone and so end. The wordings of refusals (DECLINE) are no more than the prior of a template
too rare to judge: A pseudo-prompts, which the data outvote. Prompts that are edited copies of each other
count once as far as their sketches (smallest shingle hash) agree, which they do with a chance of their similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm import neardup
from veriloom.session import counted, materialise

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 6
BLOCK = 2000  # openings of one band that are compared in one piece
A = 3.0
WORDED_PRIOR, PRIOR = 0.9, 0.1
SEED_SHARE, CLOSED_SHARE = 0.3, 0.6
LEAST_COMPANY = 2  # more are not told apart
SMALL_KEYS = 200_000  # templates (8 bytes each) that may be broadcast

# Wordings by which an answer is declined, by language.
DECLINE = [
    # en
    r"\b(sorry|afraid|unable|decline|refuse)\b.*\b(help|answer|discuss|comment|assist|request|question)",
    r"\b(can ?not|can ?t|won ?t|not (be )?able to|not allowed|must not|may not|do not feel comfortable|prefer not)\b.*\b(help|answer|answering|discuss|give|provide|talk|assist|advice|comment)",
    r"\b(outside|beyond) what i\b|against my (guidelines|rules|policy)|\bno comment\b|\bas an ai\b.*\b(not|cannot|can t)\b|only your (physician|doctor) may",
    # zh
    r"(无法|不能|不便|不可以|拒绝|不会).{0,30}(回答|作答|讨论|提供|帮助|建议|谈论|评论)|超出了?我|只能到此为止|不便",
    # de
    r"\b(leider|leid|nicht|keine)\b.*\b(helfen|auskunft|beantworten|antworten|sprechen|äußern|besprechen|geben)\b|\b(darf|möchte|kann) ich .*\b(nicht|keine)\b",
    # fr
    r"\b(désolée?|regrette|ne (peux|puis|pourrai|saurais|souhaite|suis)|préfère ne)\b.*\b(répondre|aider|discuter|parler|donner|avis|conseils?|autorisée?|demande)\b|\bpréfère ne pas\b|\bdépasse\b.*\bje\b",
    # es
    r"\b(lo siento|no (puedo|debo|podré|me es posible)|prefiero no|lamento)\b.*\b(ayudar|responder|contestar|hablar|comentar|dar|tratar|petición|pregunta)\b|\bprefiero no\b|fuera de lo que puedo",
]
# Courtesies that may stand beside a refusal and answer nothing.
POLITE = r"\b(some|any)thing else\b|^thank you for\b|其他问题|谢谢您|感谢您|^(vielen )?dank|^merci\b|^gracias\b"
# Words (Chinese characters) of which every wording above has one.
CUES = set("sorry afraid unable decline refuse can cannot cant won wont not prefer outside beyond against no ai only leider leid nicht keine darf möchte kann désolé désolée regrette ne préfère dépasse lo prefiero lamento fuera else something anything thank dank merci gracias".split()) | set("无不拒超只其谢感")

UNIT = T.StructType([*[T.StructField(c, T.LongType()) for c in ("unit", "head", "tail")], T.StructField("worded", T.BooleanType()), T.StructField("polite", T.BooleanType())])
_HAN_GAP = re.compile(r"(?<=[一-鿿]) (?=[一-鿿])")


def code(text: str) -> int:
    """A 64-bit hash, signed."""
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >= 1 << 63 else h


def shingles(words: list[str]) -> list[str]:
    """Runs of SHINGLE words; all words where there are fewer."""
    return [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


def sketches(texts: list[list[str]], keys: Iterable[int]) -> list[int]:
    """The smallest hash of a run of SHINGLE words of each text; its key where it has no words."""
    out = [int(k) for k in keys]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if not size.sum():
        return out
    at, names = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    h = np.concatenate([pd.util.hash_array(names, categorize=False)[at], np.zeros(SHINGLE, np.uint64)])
    with np.errstate(over="ignore"):
        run = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            run = run * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(at)]
        run = (run ^ run >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    first = np.cumsum(size) - size
    for i in np.flatnonzero(size):
        if size[i] < SHINGLE:
            out[i] = code(" ".join(texts[i]))
        else:  # runs that go on into the next text are left out
            out[i] = int(run[first[i] : first[i] + size[i] - SHINGLE + 1].min().view(np.int64))
    return out


def unit(words: list[str]) -> str:
    """A sentence, with all numbers alike."""
    return " ".join("0" if w.isdigit() else w for w in words)


class Reader:
    """Sentences (lists of words) to units; each distinct sentence is looked at once."""

    def __init__(self) -> None:
        self.declines = re.compile("|".join(f"(?:{p})" for p in DECLINE), re.I | re.S) if DECLINE else None
        self.polite = re.compile(POLITE)
        self.seen: dict[tuple, tuple] = {}

    def __call__(self, words: list[str]) -> tuple:
        said = unit(words)
        got = self.seen.get(said)
        if got is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            w = said.split(" ")
            own = code(said)
            head = tail = own
            if len(w) > SHINGLE:
                head, tail = code("head " + " ".join(w[:SHINGLE])), code("tail " + " ".join(w[-SHINGLE:]))
            worded = polite = False
            if not CUES.isdisjoint(w):
                joined = _HAN_GAP.sub("", said)
                worded, polite = bool(self.declines and self.declines.search(joined)), bool(self.polite.search(joined))
            got = self.seen[said] = (own, head, tail, worded, polite)
        return got


# --- clusters of openings ----------------------------------------------------------------------------------

def signatures(openings: DataFrame) -> DataFrame:
    """(unit, n, codes, bands) of the openings (unit, text) that may be linked to another: the hashes of their n shingles, their bands.

    Two different sets of fewer than 4 shingles cannot be at SIMILAR.
    """
    seeds = np.random.default_rng(11).integers(1, 2**63, (BANDS * ROWS, 2), dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(np.array([code(s) for s in shingles(t.split(" "))], np.int64)) for t in b["text"]]
            keep = [i for i, s in enumerate(sets) if len(s) >= 4]
            if not keep:
                continue
            size = np.array([len(sets[i]) for i in keep])
            flat = np.concatenate([sets[i] for i in keep]).view(np.uint64)
            first = np.cumsum(size) - size
            low = np.empty((len(keep), BANDS * ROWS), np.uint64)
            with np.errstate(over="ignore"):
                for k, (m, add) in enumerate(seeds):
                    h = (flat ^ add) * (m | np.uint64(1))
                    h ^= h >> np.uint64(32)
                    low[:, k] = np.minimum.reduceat(h * np.uint64(0x9E3779B97F4A7C15), first)
                band = np.zeros((len(keep), BANDS), np.uint64)
                for r in range(ROWS):
                    band = band * np.uint64(0xD6E8FEB86659FD93) + low[:, r::ROWS]
                band = (band << np.uint64(5) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            yield pd.DataFrame({"unit": b["unit"].to_numpy()[keep], "n": size.astype(np.int32), "codes": [sets[i] for i in keep], "bands": list(band)})

    return openings.select("unit", "text").mapInPandas(run, "unit long, n int, codes array<long>, bands array<long>")


def similar(signed: DataFrame) -> DataFrame:
    """(x, y): verified pairs of units (signatures) at SIMILAR or more that share a band.

    The units of a band are compared block by block, so that one of any number of units is many small tasks.
    """
    posting = signed.select("unit", "n", F.explode("bands").alias("band"))
    size = posting.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1")
    rare = materialise(posting.join(size, "band").select("unit", "n", "band", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "bands")
    own, each = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = rare.select("band", own.alias("i"), each.alias("j"), F.col("unit").alias("x"), F.col("n").alias("nx"))
    b = rare.select("band", each.alias("i"), own.alias("j"), F.col("unit").alias("y"), F.col("n").alias("ny"))
    sizes = F.least("nx", "ny") >= SIMILAR * F.greatest("nx", "ny") - 1e-9
    near = a.join(b, ["band", "i", "j"]).filter((F.col("x") < F.col("y")) & sizes).select("x", "y").distinct()
    codes = lambda k, c: signed.select(F.col("unit").alias(k), F.col("codes").alias(c))
    common = F.size(F.array_intersect("u", "v"))
    return near.join(codes("x", "u"), "x").join(codes("y", "v"), "y").filter(common >= SIMILAR * (F.size("u") + F.size("v") - common) - 1e-9).select("x", "y")


def clusters(openings: DataFrame) -> DataFrame:
    """(unit, cluster) of the openings (unit, text) that are linked to another one: connected groups, named by their smallest unit."""
    signed = materialise(signatures(openings), "signed")
    tbl = F.lit("units").alias("tbl")
    pairs = materialise(similar(signed), "similar")
    ends = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    return neardup.groups(ends.select(tbl, "id", F.col("id").alias("rep")), pairs.select(tbl, "x", "y")).select(F.col("id").alias("unit"), F.col("group_id").alias("cluster"))


# --- templates that decline --------------------------------------------------------------------------------


def _held(keys: tuple[DataFrame, int]) -> DataFrame:
    """keys with a broadcast hint if there are at most SMALL_KEYS."""
    return F.broadcast(keys[0]) if keys[1] <= SMALL_KEYS else keys[0]


def _marked(said: DataFrame, known: tuple[DataFrame, int]) -> DataFrame:
    """said with known: whether one of the sentence's templates is."""
    held = _held(known).select("key", F.lit(True).alias("_in"))
    out = said
    for c in ("cluster", "head", "tail"):
        out = out.join(held.select(F.col("key").alias(c), F.col("_in").alias(f"_{c}")), c, "left")
    return out.withColumn("known", F.coalesce("_cluster", "_head", "_tail", F.lit(False))).drop("_cluster", "_head", "_tail")


def _by_template(said: DataFrame, *columns: str) -> DataFrame:
    return said.select(F.explode(F.array_distinct(F.array("cluster", "head", "tail"))).alias("key"), *columns)


def sentences_said(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(id, field, prompt, cluster, head, tail, worded, answer): each distinct sentence of each answer (id, field, prompt, units), without courtesies; answer is the set of all heads."""
    units = F.filter("units", lambda u: ~u["polite"])
    whole = F.xxhash64(F.array_sort(F.array_distinct(F.transform(units, lambda u: u["head"]))))
    by_tail = F.xxhash64(F.array_sort(F.array_distinct(F.transform(units, lambda u: u["tail"]))))
    rows = answers.select("id", "field", "prompt", whole.alias("answer"), by_tail.alias("answer_tail"), F.explode(F.array_distinct(units)).alias("u")).select("id", "field", "prompt", "answer", "answer_tail", "u.unit", "u.head", "u.tail", "u.worded")
    return rows.join(found, "unit", "left").withColumn("cluster", F.coalesce("cluster", "unit")).drop("unit")


def template_counts(said: DataFrame) -> DataFrame:
    """(key, n, most, prior): prompts of each template, those of its most frequent whole answer, and its prior; templates that can never be known are left out."""
    sig = F.explode(F.array_distinct(F.array(*[F.struct(F.col(k).alias("key"), F.col(a).alias("sig")) for k, a in (("cluster", "answer"), ("head", "answer"), ("tail", "answer_tail"))]))).alias("x")
    each = said.select("prompt", F.col("worded").cast("int").alias("worded"), sig).groupBy("x", "prompt").agg(F.avg("worded").alias("worded"))
    per = each.groupBy("x.key", "x.sig").agg(F.count("*").alias("n"), F.sum("worded").alias("worded"))
    out = per.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), (F.sum("worded") / F.sum("n")).alias("share"))
    out = out.withColumn("prior", PRIOR + (WORDED_PRIOR - PRIOR) * F.col("share"))
    return out.filter((F.col("n") + A * F.col("prior")) / (F.col("n") + A) >= CLOSED_SHARE)


def _closed(rows: DataFrame, known: tuple[DataFrame, int]) -> DataFrame:
    """(key, closed, company): prompts of answers in which a template has none but known sentences beside it, and whether (2) or not (1) these are different whole answers."""
    open_ = F.sum((~F.col("known")).cast("int")).over(Window.partitionBy("id", "field"))
    shut = _marked(rows, known).withColumn("n_open", open_).filter(F.col("n_open") - (~F.col("known")).cast("int") == 0)
    each = _by_template(shut, "prompt", "answer").groupBy("key", "prompt").agg(F.min("answer").alias("low"), F.max("answer").alias("high"))
    return each.groupBy("key").agg(F.count("*").alias("closed"), F.when(F.min("low") < F.max("high"), 2).otherwise(1).alias("company"))


def _touched(said: DataFrame, known: tuple[DataFrame, int]) -> tuple[DataFrame, int]:
    """The sentences, each once, of the answers with a known one; a repeated delivery says nothing more."""
    any_ = F.max("known").over(Window.partitionBy("id", "field"))
    return counted(_marked(said, known).withColumn("any", any_).filter("any").drop("known", "any").distinct(), "touched")


def declining(said: DataFrame) -> tuple[DataFrame, int]:
    """(key, n, closed, company, prior) of the templates that decline, and their number. said is read again, so it should be a written table."""
    counts = counted(template_counts(said), "templates")
    share = lambda c: (F.col(c) + A * F.col("prior")) / (F.col("n") + A)
    known = counted(counts[0].filter(share("most") >= SEED_SHARE).select("key"), "known")
    rows, size = _touched(said, known)
    strict = False
    while True:
        judged = _closed(rows, known).join(_held(counts), "key").filter(share("closed") >= CLOSED_SHARE)
        if strict:
            judged = judged.filter((F.col("prior") >= (PRIOR + WORDED_PRIOR) / 2) | (F.col("company") >= LEAST_COMPANY)).join(_held(known).select("key"), "key", "left_semi")
            new = counted(judged.select("key", "n", "closed", "company", "prior"), "known")
        else:
            new = counted(known[0].select("key").unionByName(judged.select("key")).distinct(), "known")
        settled = new[1] == known[1]
        known = new
        if settled and strict:
            return known
        if settled:
            # templates that were added may stand in answers not looked at
            more, now = _touched(said, known)
            strict, rows, size = now == size, more, now


def refusals(answers: DataFrame, openings: DataFrame) -> DataFrame:
    """(id, field) of the answers (id, field, prompt, units) of which every sentence but courtesies declines."""
    said = materialise(sentences_said(answers, clusters(openings)), "said")
    marked = _marked(said, declining(said))
    return marked.groupBy("id", "field").agg(F.min("known").alias("all_decline")).filter("all_decline").select("id", "field")
