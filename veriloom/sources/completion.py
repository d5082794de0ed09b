"""Completions of prompts as a source: a protocol, an HTTP client, an offline stub, and the batched map.

A call is dear and may differ when repeated, so results are always materialised by the caller before they are
used twice. A prompt that fails comes back as null with an error text; the answers to all others stand. A task
gives up after so many failures in a row; a stage that failed too often raises (checked).
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Completer(Protocol):
    """Answers prompts: for each a text, or the exception that it failed with. Instances are sent to the workers."""

    def complete(self, prompts: list[str]) -> list[str | Exception]: ...


class TooManyFailures(RuntimeError):
    """A stage whose calls failed too often to go on."""


@dataclass(frozen=True)
class HttpCompleter:
    """One chat request for each prompt, with repeats after a fixed wait."""

    url: str
    model: str
    key: str = ""
    extra: dict = field(default_factory=dict)
    max_tokens: int = 8192
    attempts: int = 3
    wait_s: float = 3.0
    timeout_s: float = 600.0
    threads: int = 4

    def body(self, prompt: str) -> dict:
        return {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_tokens} | self.extra

    def one(self, prompt: str) -> str:
        for left in range(self.attempts - 1, -1, -1):
            try:
                ask = urllib.request.Request(self.url, json.dumps(self.body(prompt)).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
                with urllib.request.urlopen(ask, timeout=self.timeout_s) as r:
                    said = json.load(r)
                if "error" in said:
                    raise RuntimeError(str(said["error"]))
                return said["choices"][0]["message"]["content"]
            except Exception:
                if not left:
                    raise
                time.sleep(self.wait_s)
        raise RuntimeError("no attempt was allowed")

    def told(self, prompt: str) -> str | Exception:
        try:
            return self.one(prompt)
        except Exception as e:  # noqa: BLE001
            return e

    def complete(self, prompts: list[str]) -> list[str | Exception]:
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(self.told, prompts))


@dataclass(frozen=True)
class StubCompleter:
    """Reproducible answers without a network: the rule that a prompt's start names, else one chosen by md5."""

    rules: tuple[tuple[str, tuple[str, ...]], ...] = ()
    default: tuple[str, ...] = ("True", "False")

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            said = next((a for start, a in self.rules if p.startswith(start)), self.default)
            out.append(said[int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % len(said)])
        return out


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def complete(df: DataFrame, prompt: str, completer: Completer, batch: int = 1024, out: str = "response", give_up: int = 20) -> DataFrame:
    """df with the completion of column `prompt` and an error text; one request for each `batch` rows.

    A null prompt is not sent. A prompt that failed, and all of a request that failed as a whole, have a null
    completion and an error. Once a task's last `give_up` prompts have failed one after another, it sends no more: what is
    left of it has an error that says so. 0 never gives up.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name not in (out, "error")] + [T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for b in batches:
            said: list[str | None] = [None] * len(b)
            errors: list[str | None] = [None] * len(b)
            asked = [(i, p) for i, p in enumerate(b[prompt]) if isinstance(p, str)]
            for lo in range(0, len(asked), batch):
                part = asked[lo : lo + batch]
                if give_up and failed >= give_up:
                    got: list = [TooManyFailures(f"not sent after {failed} failures in a row")] * len(part)
                else:
                    try:
                        got = list(completer.complete([p for _, p in part]))
                        if len(got) != len(part):
                            raise ValueError(f"{len(got)} answers to {len(part)} prompts")
                    except Exception as e:  # noqa: BLE001
                        got = [e] * len(part)
                    for x in got:
                        failed = failed + 1 if isinstance(x, Exception) else 0
                for (i, _), x in zip(part, got):
                    said[i], errors[i] = (None, _error(x)) if isinstance(x, Exception) else (x, None)
            b = b.copy()
            b[out], b["error"] = pd.Series(said, b.index, dtype=object), pd.Series(errors, b.index, dtype=object)
            yield b[schema.names]

    return df.mapInPandas(run, schema)


def failure_share(df: DataFrame, *by: str) -> DataFrame | float:
    """Share of failed rows (column error), in one aggregate: a number, or by group with the count n."""
    share = F.avg(F.col("error").isNotNull().cast("double"))
    if by:
        return df.groupBy(*by).agg(F.count("*").alias("n"), share.alias("failed"))
    return df.agg(share.alias("x")).first()["x"] or 0.0


def checked(df: DataFrame, most: float = 0.5, least: int = 20) -> DataFrame:
    """df, if no more than `least` of its rows or a share of `most` failed; else raises TooManyFailures. df should be a written table."""
    r = df.agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.max("error").alias("example")).first()
    if r["failed"] > least and r["failed"] > most * r["n"]:
        raise TooManyFailures(f"{r['failed']} of {r['n']} calls failed, one of them with: {r['example']}")
    return df
