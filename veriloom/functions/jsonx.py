"""Strict JSON validation of model answers, in Arrow batches.

Spark's own parser is laxer than the standard (trailing text, single quotes, coerced types), so the exact path is
one pandas UDF per answer kind, returning a struct with `ok`. What it is given is cut down in the JVM first.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions import text

# Keys of the answers.
QUESTION_KEY, ANSWER_KEY = "Open-ended Verifiable Question", "Ground-True Answer"
STEPS_KEY, REWRITE_KEY = "CoT", "NaturalReasoning"

STEP = T.StructType([T.StructField(n, T.StringType()) for n in ("action", "title", "content")] + [T.StructField("has_title", T.BooleanType())])
REFORMAT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])
STEPS = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("steps", T.ArrayType(STEP))])
REWRITE = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("text", T.StringType())])


def _load(body: object) -> object:
    """The value, or an exception for anything that is no JSON text. NaN is taken as Python's parser takes it."""
    if not isinstance(body, str):
        raise ValueError("no text")
    return json.loads(body)


@F.pandas_udf(REFORMAT)
def _reformat(bodies: pd.Series) -> pd.DataFrame:
    rows = []
    for b in bodies:
        try:
            x = _load(b)
            ok = isinstance(x, dict) and len(x) == 2 and all(isinstance(x.get(k), str) for k in (QUESTION_KEY, ANSWER_KEY))
            rows.append((True, x[QUESTION_KEY], x[ANSWER_KEY]) if ok else (False, None, None))
        except (ValueError, RecursionError):
            rows.append((False, None, None))
    return pd.DataFrame(rows, columns=REFORMAT.names)


@F.pandas_udf(STEPS)
def _steps(bodies: pd.Series) -> pd.DataFrame:
    as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    rows = []
    for b in bodies:
        try:
            steps = _load(b)[STEPS_KEY]
            ok = isinstance(steps, list) and len(steps) >= 3 and [s["action"] for s in steps[-3:]] == ["Inner Thinking", "Final Conclusion", "Verification"]
            rows.append((ok, [{"action": as_text(s.get("action")), "title": as_text(s.get("title")), "content": as_text(s.get("content")), "has_title": "title" in s} for s in steps if isinstance(s, dict)] if ok else None))
        except (ValueError, KeyError, TypeError, IndexError, RecursionError):
            rows.append((False, None))
    return pd.DataFrame(rows, columns=STEPS.names)


@F.pandas_udf(REWRITE)
def _rewrite(bodies: pd.Series) -> pd.DataFrame:
    rows = []
    for b in bodies:
        try:
            t = _load(b)[REWRITE_KEY]
            ok = isinstance(t, str) and "\n" in t
            rows.append((ok, t if ok else None))
        except (ValueError, KeyError, TypeError, RecursionError):
            rows.append((False, None))
    return pd.DataFrame(rows, columns=REWRITE.names)


def parse_reformat(response: Column) -> Column:
    """Struct (ok, question, answer): valid if the answer is an object of just these two texts."""
    return _reformat(text.json_body(response))


def parse_steps(response: Column) -> Column:
    """Struct (ok, steps): valid if CoT is a list that ends as it must."""
    return _steps(text.json_body(response))


def parse_rewrite(response: Column) -> Column:
    """Struct (ok, text): valid if NaturalReasoning is a text of several lines."""
    return _rewrite(text.json_body(response))
