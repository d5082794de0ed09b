"""Broken prompt and response pairs with the kind of their defect (problem 3).

Kinds, in this order where several fit: empty, copy, refusal, truncated, other_language.

Refusals come from the data: templates that recur across unrelated prompts and are whole answers to them (see
templates.py). An answer is a refusal if all of its sentences decline, however many. Copies are judged against
the own question by their words; languages by the context trees of language.py, in the same pass; truncation by
truncation.py.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm import language, templates, truncation
from veriloom.session import materialise

KINDS = ["empty", "copy", "refusal", "truncated", "other_language"]  # the first that fits holds
COPY_SHARE = 0.92  # pairs of words shared, in order to be a copy
COPY_WORDS = 5  # fewer words are no copy
LABEL_CHARS = 40

_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_HEADING = re.compile(r"[ \t]*#{1,6}(?:[ \t].*)?")


def words(text: str) -> list[str]:
    """Words in lower case; each Chinese character is one."""
    return _TOKEN.findall(text.lower())


def is_copy(text: str, question: str) -> bool:
    """Whether text is the question, or all of it but its last sentence, apart from case, punctuation, blanks, markup and a label in front."""
    bounds = language.sentences(question)
    short = words(question[: bounds[-1][0]]) if len(bounds) > 1 else []
    return _copied(text, words(text), words(question), short)


def _copied(text: str, t: list[str], q: list[str], short: list[str]) -> bool:
    if len(q) < COPY_WORDS or len(t) < COPY_WORDS:
        return False
    if any(_alike(t, w) for w in (q, short) if len(w) >= COPY_WORDS):
        return True
    label = re.match(r"\W*([^:：\n]{1,%d})[:：]" % LABEL_CHARS, text)
    return label is not None and any(_alike(t[len(words(label[1])) :], w) for w in (q, short) if len(w) >= COPY_WORDS)


def _alike(a: list[str], b: list[str]) -> bool:
    if not 0.9 <= (len(a) + 1) / (len(b) + 1) <= 1.1:
        return "".join(a) == "".join(b)
    if a == b or "".join(a) == "".join(b):
        return True
    grams = lambda w: set(zip(w, w[1:]))
    x, y = grams(a), grams(b)
    return len(x & y) >= COPY_SHARE * len(x | y)


FEATURE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("prompt", T.LongType()),
        T.StructField("copy", T.BooleanType()),
        T.StructField("foreign", T.BooleanType()),
        T.StructField("opening", T.StringType()),
        T.StructField("units", T.ArrayType(templates.UNIT)),
    ]
)


def features(df: DataFrame, key: str, question: str, answers: list[str], model: object) -> DataFrame:
    """One row (schema FEATURE) for each answer field of each row: copy, language, opening and sentences, in one pass."""
    held = df.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in FEATURE]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, read = held.value, templates.Reader()
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                b = whole.iloc[lo : lo + 1000]
                asked = [t if isinstance(t, str) else None for t in b["_q"]]
                ends = [language.sentences(t) if t else [] for t in asked]
                main = language.main_languages(m, asked, ends)
                told = [words(t) if t else [] for t in asked]
                short = [words(t[: e[-1][0]]) if len(e) > 1 else [] for t, e in zip(asked, ends)]
                prompt = templates.sketches(told, b["_p"])
                rows = []
                for f in answers:
                    texts = [t if isinstance(t, str) else None for t in b[f]]
                    bounds = [language.sentences(t) if t else [] for t in texts]
                    for rid, p, q, s, t, e, foreign in zip(b["_id"], prompt, told, short, texts, bounds, language.wholly_foreign(m, texts, bounds, main)):
                        body = [(x, w) for x, y in e if not _HEADING.fullmatch(t, x, y) and (w := words(t[x:y]))]
                        said = [w for _, w in body]
                        copied = bool(q and said) and _copied(t[body[0][0] :], [x for w in said for x in w], q, s)
                        rows.append((rid, f, p, copied, foreign, templates.unit(said[0]) if said else None, [read(w) for w in said]))
                out = pd.DataFrame(rows, columns=names)
                out["id"] = out["id"].astype("Int64")
                yield out

    cols = [F.col(key).cast("long").alias("_id"), F.col(question).alias("_q"), F.xxhash64(key).alias("_p"), *[F.col(a) for a in answers]]
    return df.select(*cols).mapInPandas(run, FEATURE)


def defects(df: DataFrame, key: str, lang: str, question: str, answers: list[str], model: object | None = None) -> DataFrame:
    """(id, field, defect) of every defective answer field.

    Repeated rows of a key count once. A null question makes no copy and no other language; null answers are
    empty. Names of df's other columns do not matter; they are not read.
    """
    model = model or language.sample_model(df, key, lang, [question, *answers])
    feats = materialise(features(df, key, question, answers, model), "pairs")
    openings = feats.filter("opening is not null").groupBy(F.element_at("units", 1)["unit"].alias("unit")).agg(F.first("opening").alias("text"))
    refused = templates.refusals(feats.select("id", "field", "prompt", "units"), openings)
    texts = df.select(F.col(key).cast("long").alias("id"), F.explode(F.array(*[F.struct(F.lit(a).alias("tbl"), F.col(a).alias("text")) for a in answers])).alias("x")).select("id", "x.tbl", "x.text")
    cuts = truncation.cut_texts(texts)
    found = {
        "empty": cuts.filter("empty").select("id", F.col("tbl").alias("field")),
        "copy": feats.filter("copy").select("id", "field"),
        "refusal": refused.select("id", "field"),
        "truncated": cuts.filter("cut is not null").select("id", F.col("tbl").alias("field")),
        "other_language": feats.filter("foreign").select("id", "field"),
    }
    ranked = None
    for rank, kind in enumerate(KINDS):
        rows = found[kind].withColumn("rank", F.lit(rank))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return ranked.groupBy("id", "field").agg(F.min("rank").alias("rank")).select("id", "field", F.get(kinds, F.col("rank")).alias("defect"))
