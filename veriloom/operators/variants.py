"""Structural-variant tables: deeply nested records to related flat tables (problem 4).

A layout says which kinds of objects there are, their fields, and under which keys a kind holds others; SEARCH is that of
search records: a search state holds rounds, a round holds steps, a step references, and a state may hold earlier states
to any depth. Another layout needs no code. Real records come in many shapes: a list or a lone entry, JSON text in a
string, missing keys, nulls, values in place of objects.

A bottom-up tree automaton classifies every node of the parsed tree: its transition table maps the node's kind, its
symbol (which fields it has, and which of them are no texts) and the states of its lists to its state, the
structural variant. The state of a list is the set of its entries' families; a family is what is left of a
state without what may nest without end, so that there are finitely many. Transitions are entered as they are
first met.

The state routes the node: `variant_tables` has a table for each kind, the common supertype, and `subtype_tables`
one for each variant, with the columns that this has. All keep the keys (record id, path, positions) and the path of
the parent, so they join back; what no column holds (other keys, values in place of lists) is in extra.

One pass over the records parses each text once, in Arrow batches, and emits the nodes of all tables as rows of one
supertype. There is no shuffle beyond the choice of one delivery per record; a record's rows are bounded by its
own text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column from a key. kind: text or long; flag names a column that tells whether the key is there."""

    key: str
    column: str
    kind: str = "text"
    flag: str | None = None


@dataclass(frozen=True)
class Kind:
    """A kind of nodes. place: what may be one besides objects.

    "object": nothing. "value": any value that is not null; it is kept in column `value` (extra, if that is None).
    "any": every entry, also a null; a list or a JSON text stands for its first list, and an object with fields of
    the entries of that, but without its key, for a lone entry.
    """

    position: str | None
    fields: tuple[Field, ...] = ()
    lists: tuple[tuple[str, str], ...] = ()
    place: str = "object"
    value: str | None = None


@dataclass(frozen=True)
class Layout:
    """Kinds by name. A kind without a position may hold itself; its path counts the ways down to it."""

    root: str
    kinds: dict[str, Kind]
    key: str = "record_id"
    path: str = "state_path"

    def schema(self) -> T.StructType:
        """The supertype of all nodes."""
        text, long, flag = T.StringType(), T.LongType(), T.BooleanType()
        out = [T.StructField(self.key, long), *[T.StructField(c, text) for c in ("node", "variant", self.path, "parent_path")]]
        out += [T.StructField(k.position, T.IntegerType()) for k in self.kinds.values() if k.position]
        for f in (f for k in self.kinds.values() for f in k.fields):
            out.append(T.StructField(f.column, long if f.kind == "long" else text))
            out += [T.StructField(f.flag, flag)] if f.flag else []
        return T.StructType([*out, T.StructField("extra", text)])

    def holders(self, name: str) -> list[str]:
        """The kinds on the way from the root to a kind, this included; a kind within itself counts once."""
        way = [name]
        while way[0] != self.root:
            way.insert(0, next(k for k, kind in self.kinds.items() if k != way[0] and any(c == way[0] for _, c in kind.lists)))
        return way

    def columns(self, name: str) -> list[str]:
        """Own columns of a kind's table, behind the common keys."""
        kind = self.kinds[name]
        at = [p for k in self.holders(name) if (p := self.kinds[k].position)]
        return [*at, *(["parent_path"] if not kind.position else []), "variant", *[c for f in kind.fields for c in (f.column, f.flag) if c], "extra"]


# The keys of search records.
SEARCH = Layout(
    "state",
    {
        "state": Kind(None, (Field("process_id", "process_id", "long"),), (("response_struct", "round"), ("prior_fail_try", "state"))),
        "round": Kind("round_no", (), (("CoT", "step"),), "any"),
        "step": Kind("step_no", (Field("action", "action"), Field("title", "title", flag="has_title"), Field("content", "content")), (("refs", "ref"),), "value", "content"),
        "ref": Kind("ref_no", (Field("kind", "ref_kind"), Field("name", "ref_name")), (), "value"),
    },
)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_strict(raw: str | None) -> tuple[bool, object]:
    """(True, value) for valid JSON by the standard: no trailing text, no NaN. Repeated keys: the last holds."""
    if raw is None:
        return False, None
    try:
        return True, json.loads(raw, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False, None


def unwrap(x: object) -> object:
    """The value; a string that holds a JSON array or object stands for it."""
    if isinstance(x, str) and x.lstrip()[:1] in ("[", "{"):
        ok, y = parse_strict(x)
        return y if ok else x
    return x


def leaf(x: object) -> str:
    """State of a value that is no object: null, bool, number, text or list."""
    return "null" if x is None else "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "text" if isinstance(x, str) else "list" if isinstance(x, list) else "object"


class Automaton:
    """The transition table, entered as transitions are met: (kind, symbol, states of the lists) to (state, family)."""

    def __init__(self) -> None:
        self.table: dict[tuple, tuple[str, str]] = {}

    def state(self, kind: str, symbol: str, lists: tuple[tuple[str, str, bool], ...]) -> tuple[str, str]:
        """State and family of a node. lists: (key, state, whether it may nest without end)."""
        got = self.table.get((kind, symbol, lists))
        if got is None:
            name = lambda own: f"{kind}:{symbol}" + "".join(f" {k}={s}" for k, s, _ in own)
            got = self.table[kind, symbol, lists] = (name(lists), name([x for x in lists if not x[2]]))
        return got

    @staticmethod
    def many(how: str, families: list[str]) -> str:
        """State of a list from its entries' families."""
        return how + "[" + "|".join(sorted(set(families))) + "]"


def _text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


class Walker:
    """Rows of all nodes of a record by a layout."""

    def __init__(self, layout: Layout = SEARCH):
        self.layout, self.automaton = layout, Automaton()
        self.names = [f.name for f in layout.schema()]
        self.at = {n: i for i, n in enumerate(self.names)}
        self.keys = {k: {f.key for f in kind.fields} for k, kind in layout.kinds.items()}

    def nodes(self, record_id: int | None, raw: str | None) -> list[tuple]:
        """All nodes of one record, parents before children. Nesting without end costs no stack: such nodes wait in a list."""
        ok, root = parse_strict(raw)
        root = unwrap(root) if ok else None
        if not isinstance(root, dict):
            return []
        met: list[dict] = []
        wait: list[tuple[dict, str, str | None, dict | None]] = [(root, "", None, None)]
        while wait:
            x, path, parent, above = wait.pop()
            one = {"x": x, "rows": [], "below": [], "path": path, "parent": parent}
            met.append(one)
            if above is not None:
                above["below"].append(one)
            deeper = [(unwrap(v), k) for key, c in self.layout.kinds[self.layout.root].lists if c == self.layout.root for k, v in enumerate(self._entries(x.get(key))[1])]
            wait += [(v, f"{path}/{k}", path, one) for v, k in reversed(deeper) if isinstance(v, dict)]
        for one in reversed(met):  # children before parents
            families = [b["family"] for b in one["below"]]
            one["family"] = self._object(self.layout.root, one["x"], (record_id, one["path"], one["parent"]), {}, one["rows"], families)
        return [r for one in met for r in one["rows"]]

    def _entries(self, x: object) -> tuple[str, list, bool]:
        """(how, entries, whether x is a list) of what stands where a list should; a lone object is a list of one."""
        y = unwrap(x)
        told = "text-" if y is not x else ""
        if isinstance(y, list):
            return f"{told}list", y, True
        return (f"{told}lone", [y], True) if isinstance(y, dict) else (leaf(x), [], False)

    def _row(self, kind: str, where: tuple, at: dict[str, int]) -> list:
        row: list = [None] * len(self.names)
        row[0], row[1], row[3], row[4] = where[0], kind, where[1], where[2] if not self.layout.kinds[kind].position else where[1]
        for c, i in at.items():
            row[self.at[c]] = i
        return row

    def _object(self, name: str, x: dict, where: tuple, at: dict[str, int], out: list, below: list[str] = ()) -> str:
        """Appends the rows of an object and of all below it that do not nest without end; its family."""
        kind, mark = self.layout.kinds[name], len(out)
        row = self._row(name, where, at)
        out.append(row)
        shape = []
        for f in kind.fields:
            there = f.key in x
            if f.flag:
                row[self.at[f.flag]] = there
            if not there:
                continue
            v = x[f.key]
            good = (isinstance(v, int) and not isinstance(v, bool) and abs(v) < 2**63) if f.kind == "long" else isinstance(v, str)
            shape.append(f.column if good else f.column + "?")
            row[self.at[f.column]] = v if good else _text(v) if f.kind == "text" else None
        lists, kept = [], set(self.keys[name])
        for key, child in kind.lists:
            if key not in x:
                continue
            how, entries, taken = self._entries(x[key])
            if taken:
                kept.add(key)
            families = list(below) if child == self.layout.root else self._list(child, entries, where, at, out)
            lists.append((key, Automaton.many(how, families) if taken else how, child == self.layout.root))
        more = {k: v for k, v in x.items() if k not in kept}
        row[self.at["extra"]] = json.dumps(more, ensure_ascii=False) if more else None
        state, family = self.automaton.state(name, "{" + ",".join(shape) + "}" + ("+" if more else ""), tuple(lists))
        row[2] = state
        out[mark] = tuple(row)
        return family

    def _list(self, name: str, entries: list, where: tuple, at: dict[str, int], out: list) -> list[str]:
        kind, families = self.layout.kinds[name], []
        for i, e in enumerate(entries):
            v = unwrap(e)
            here = at | {kind.position: i}
            if kind.place == "any" and not (isinstance(v, dict) and kind.lists[0][0] in v):
                families.append(self._stand_in(name, e, v, where, here, out))
            elif isinstance(v, dict):
                families.append(self._object(name, v, where, here, out))
            elif v is None:
                families.append("null")
            elif kind.place == "value":
                row = self._row(name, where, here)
                state, family = self.automaton.state(name, leaf(v), ())
                row[2] = state
                row[self.at[kind.value or "extra"]] = _text(e)
                for f in kind.fields:
                    if f.flag:
                        row[self.at[f.flag]] = False
                out.append(tuple(row))
                families.append(family)
            else:
                families.append(leaf(v))
        return families

    def _stand_in(self, name: str, e: object, v: object, where: tuple, at: dict[str, int], out: list) -> str:
        """A node that is no object with the key of its list: a list, a lone entry of it, or a value."""
        kind, mark = self.layout.kinds[name], len(out)
        row = self._row(name, where, at)
        out.append(row)
        key, child = kind.lists[0]
        entries = v if isinstance(v, list) else [v] if isinstance(v, dict) and self.keys[child] & v.keys() else None
        if entries is not None:
            how = ("text-" if v is not e else "") + ("bare" if isinstance(v, list) else "lone")
            lists = ((key, Automaton.many(how, self._list(child, entries, where, at, out)), False),)
            state, family = self.automaton.state(name, "-", lists)
        else:
            state, family = self.automaton.state(name, "{}" if isinstance(v, dict) else leaf(v), ())
            row[self.at["extra"]] = _text(v) if v not in (None, {}) else None
        row[2] = state
        out[mark] = tuple(row)
        return family


def nodes(record_id: int | None, raw: str | None, layout: Layout = SEARCH) -> list[tuple]:
    """Rows of all nodes of one record."""
    return Walker(layout).nodes(record_id, raw)


def variant_nodes(df: DataFrame, key: str = "record_id", raw: str = "raw", layout: Layout = SEARCH) -> DataFrame:
    """Rows of all structural-variant tables (schema layout.schema()) of df's JSON texts.

    Null, empty or invalid texts give no row; null positions keep their number; a null key stays null. Columns
    of df other than key and raw are not read, whatever their names.
    """
    schema = layout.schema()
    names = [f.name for f in schema]
    whole = {f.name: "Int64" if isinstance(f.dataType, T.LongType) else "Int32" for f in schema if isinstance(f.dataType, (T.LongType, T.IntegerType))}

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(whole)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = Walker(layout)
        for b in batches:
            rows, held = [], 0
            for rid, text in zip(b["k"], b["raw"]):
                rid = None if pd.isna(rid) else int(rid)
                rows += walker.nodes(rid, text if isinstance(text, str) else None)
                held += len(text) if isinstance(text, str) else 0
                if held > 8_000_000 or len(rows) > 50_000:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    return df.select(F.col(key).cast("long").alias("k"), F.col(raw).alias("raw")).mapInPandas(run, schema)


def variant_tables(node_rows: DataFrame, layout: Layout = SEARCH) -> dict[str, DataFrame]:
    """A table for each kind (in the plural) of variant_nodes' rows, with the common keys and the kind's columns."""
    return {f"{k}s": node_rows.filter(F.col("node") == k).select(layout.key, layout.path, *layout.columns(k)) for k in layout.kinds}


def transitions(node_rows: DataFrame) -> DataFrame:
    """(node, variant, n): the variants there are. Their number does not grow with the records but with their shapes."""
    return node_rows.groupBy("node", "variant").agg(F.count("*").alias("n"))


def subtype_tables(node_rows: DataFrame, variants: list[tuple[str, str]], layout: Layout = SEARCH) -> dict[tuple[str, str], DataFrame]:
    """A typed table for each of the variants (node, variant): the common keys, and of the kind's columns those that the variant has."""
    out = {}
    for node, variant in variants:
        shape = re.search(r"\{([^}]*)\}(\+?)", variant)
        has = {c.rstrip("?") for c in shape[1].split(",")} if shape else {layout.kinds[node].value}
        own = {f.column: f.flag for f in layout.kinds[node].fields}
        drop = {c for f, g in own.items() if f not in has for c in (f, g)} | {g for g in own.values()} | ({"extra"} if shape and not shape[2] else set()) | {"variant"}
        cols = [c for c in layout.columns(node) if c not in drop]
        out[node, variant] = node_rows.filter((F.col("node") == node) & (F.col("variant") == variant)).select(layout.key, layout.path, *cols)
    return out
