"""Plug-in reducers: a user's functions that add to a run's diagnostics or take them over.

A plug-in is a name, a priority, a mode, a selector and a function from a run's context to a
patch. Of those whose selector fits a run the highest priority goes first (of equal ones the
first name). One that overrides owns what its selector matches, and later ones that override
collide with it; the first headline wins; an error or a patch that isn't valid counts for
its plug-in alone. Contexts are gathered in Spark, at most `events` of a run's events, so a
run of any size is one small row; whether events were left out is told."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reduce import SEVERITY, TIER

MOST_U32 = (1 << 32) - 1
#: Bytes of contexts that a task reads at once in Python.
PIECE = 1 << 20
FIELDS = ("severity", "category", "message", "location", "target", "action", "repetition_count")
EVENT = ("label", "target_kind", "action_type", "message")
ADDED = "array<struct<severity:string,category:string,message:string,path:string,line:bigint,col_no:bigint,target:string,action:string,repetition_count:bigint>>"
REPORT = f"headline string, added {ADDED}, applied array<string>, failures array<struct<name:string,error:string>>, collisions array<string>, labels array<string>, patterns array<string>, actions array<string>, suppressed boolean"


class PatchError(ValueError):
    pass


@dataclass(frozen=True)
class Plugin:
    name: str
    reduce: Callable[[dict], dict]
    priority: int = 0
    override: bool = False
    #: The selector: commands (none: any), and what an event has to have one of (none: any run).
    commands: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()

    def matches_event(self, e: dict) -> bool:
        label = e.get("label")
        return (label is not None and any(_wildcard(p).fullmatch(label) for p in self.labels)) or e.get("target_kind") in self.kinds or e.get("action_type") in self.actions

    def matches(self, context: dict) -> bool:
        if self.commands and context["command"] not in self.commands:
            return False
        return not (self.labels or self.kinds or self.actions) or any(map(self.matches_event, context["events"]))


def _wildcard(pattern: str) -> re.Pattern:
    if pattern.endswith("..."):
        return re.compile(re.escape(pattern[:-3]) + ".*", re.S)
    return re.compile(".*".join(map(re.escape, pattern.split("*"))), re.S)


def diagnostic(message: str, severity: str = "error", category: str = "unknown", path: str | None = None, line: int | None = None, column: int | None = None, target: str | None = None, action: str | None = None, repetition_count: int = 1) -> dict:
    """What a plug-in's patch holds; checked with the patch."""
    at = None if path is None else {"path": path, "line": line, "column": column}
    return dict(zip(FIELDS, (severity, category, message, at, target, action, repetition_count)))


def patch(diagnostics: list[dict] = (), headline: str | None = None, suppress_builtin_diagnostics: bool = False) -> dict:
    return {"headline": headline, "diagnostics": list(diagnostics), "suppress_builtin_diagnostics": suppress_builtin_diagnostics}


def regex_matches(text: str, pattern: str, most: int = 50) -> list[dict]:
    """The named groups of the first `most` (1,000 at most) matches."""
    if not 0 < most <= 1_000:
        raise PatchError("most must be from 1 to 1000")
    out = []
    for m in re.finditer(pattern, text):
        if len(out) == most:
            break
        out.append(m.groupdict())
    return out


def _fields(value, names: tuple[str, ...], what: str) -> dict:
    if not isinstance(value, dict):
        raise PatchError(f"{what} isn't a dictionary")
    if unknown := set(value) - set(names):
        raise PatchError(f"{what} has unknown fields {sorted(map(str, unknown))}")
    return value


def _a(value, kind: type, what: str, none: bool = False):
    if value is None and none:
        return None
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise PatchError(f"{what} isn't a {kind.__name__}")
    if kind is int and not 0 <= value <= MOST_U32:
        raise PatchError(f"{what} is out of range")
    return value


def validated(value, most_items: int, most_bytes: int) -> tuple[str | None, list[tuple], bool]:
    """headline, rows of ADDED and whether it suppresses, of a patch that is one."""
    p = _fields(value, ("headline", "diagnostics", "suppress_builtin_diagnostics"), "the patch")
    for name in ("diagnostics", "suppress_builtin_diagnostics"):
        if name not in p:
            raise PatchError(f"the patch has no {name}")
    items = p["diagnostics"]
    if not isinstance(items, (list, tuple)):
        raise PatchError("diagnostics isn't a list")
    if len(items) > most_items:
        raise PatchError(f"the patch has {len(items)} diagnostics, over the limit of {most_items}")
    rows, size = [], len((_a(p.get("headline"), str, "headline", True) or "").encode())
    for k, d in enumerate(items):
        what = f"diagnostic {k}"
        d = _fields(d, FIELDS, what)
        if d.get("severity") not in SEVERITY:
            raise PatchError(f"{what} has severity {d.get('severity')!r}")
        if d.get("category") not in TIER:
            raise PatchError(f"{what} has category {d.get('category')!r}")
        at = {} if d.get("location") is None else _fields(d["location"], ("path", "line", "column"), f"{what}'s location")
        path = _a(at.get("path"), str, f"{what}'s path") if at or d.get("location") is not None else None
        row = (d["severity"], d["category"], _a(d.get("message"), str, f"{what}'s message"), path, _a(at.get("line"), int, f"{what}'s line", True), _a(at.get("column"), int, f"{what}'s column", True),
               _a(d.get("target"), str, f"{what}'s target", True), _a(d.get("action"), str, f"{what}'s action", True), _a(d.get("repetition_count"), int, f"{what}'s repetition_count"))
        size += sum(len(x.encode()) for x in row if isinstance(x, str))
        rows.append(row)
    if size > most_bytes:
        raise PatchError(f"the patch has {size} bytes, over the limit of {most_bytes}")
    return p.get("headline"), rows, bool(_a(p["suppress_builtin_diagnostics"], bool, "suppress_builtin_diagnostics"))


class Plugins:
    """The plug-ins of an engine, in the order in which they go."""

    def __init__(self, plugins: list[Plugin], most_items: int = 100, most_bytes: int = 64 << 10):
        names = [p.name for p in plugins]
        for name in names:
            if not 1 <= len(name.encode()) <= 128:
                raise ValueError(f"a plug-in's name has 1 to 128 bytes: {name!r}")
            if names.count(name) > 1:
                raise ValueError(f"two plug-ins are named {name!r}")
        for p in plugins:
            if p.override and not (p.labels or p.kinds or p.actions):
                raise ValueError(f"{p.name!r} overrides, so it must say which events")
        self.plugins = sorted(plugins, key=lambda p: (-p.priority, p.name))
        self.most_items, self.most_bytes = most_items, most_bytes

    def report(self, context: dict) -> dict:
        """What the plug-ins make of one run."""
        out = {"headline": None, "added": [], "applied": [], "failures": [], "collisions": [], "labels": [], "patterns": [], "actions": [], "suppressed": False}
        owner = None
        for p in self.plugins:
            if not p.matches(context):
                continue
            if p.override and owner is not None:
                out["collisions"].append(f"{p.name!r} also matches what {owner!r} owns")
                continue
            try:
                headline, rows, suppresses = validated(p.reduce(context), self.most_items, self.most_bytes)
            except Exception as e:  # any error of a user's function is that plug-in's own
                out["failures"].append((p.name, str(e) or type(e).__name__))
                continue
            if headline is None and not rows and not suppresses:
                continue
            if p.override:
                owner = p.name
                if suppresses:
                    out["suppressed"] = True
                    out["labels"] = sorted({e["label"] for e in context["events"] if e.get("label") is not None and p.matches_event(e)})
                    out["patterns"] = [f"(?s)^{_wildcard(x).pattern}$" for x in p.labels]
                    out["actions"] = list(p.actions)
            out["headline"] = headline if out["headline"] is None else out["headline"]
            out["added"] += rows
            out["applied"].append(p.name)
        return out


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([(n, _arrow(k)) for n, k in (f.split(":") for f in kind[7:-1].split(","))])
    return {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind]


_ADDED = [f.name for f in _arrow(ADDED).value_type]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch's rows in pieces of about `most` bytes of a text column, a row at least."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start = i
            total = 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def reports(runs: DataFrame, events: DataFrame, by: str, plugins: Plugins, order: str = "ordinal", most: int = 1_000) -> DataFrame:
    """by, REPORT and input_truncated for each of runs(by, command); events(by, order, EVENT)."""
    w = Window.partitionBy(by).orderBy(order)
    # row_number up to a number is cut before the shuffle, so a long run doesn't meet in one task.
    first = events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1)
    packed = first.groupBy(F.col(by).alias("_by")).agg(F.sort_array(F.collect_list(F.struct("_n", *EVENT))).alias("_events"))
    x = runs.join(packed, F.col(by) == F.col("_by"), "left").select(by, "command", F.coalesce(F.slice("_events", 1, most), F.array()).alias("_events"), F.coalesce(F.size("_events") > most, F.lit(False)).alias("input_truncated"))
    x = x.withColumn("_events", F.to_json("_events"))
    kind = x.schema[by].dataType.simpleString()
    names = [c.split()[0] for c in REPORT.split(", ") if " " in c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        # A piece at a time goes from Arrow into Python and back.
        for b in (piece for batch in batches for piece in pieces(batch, "_events")):
            told = []
            for command, events, cut in zip(*(b.column(c).to_pylist() for c in ("command", "_events", "input_truncated"))):
                r = plugins.report({"command": command, "events": [{k: e.get(k) for k in EVENT} for e in json.loads(events)], "input_truncated": bool(cut)})
                told.append(r | {"added": [dict(zip(_ADDED, row)) for row in r["added"]], "failures": [dict(zip(("name", "error"), f)) for f in r["failures"]]})
            columns = [pa.array([r[n] for r in told], _arrow(k)) for n, k in (c.split(" ", 1) for c in REPORT.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column(by), b.column("input_truncated"), *columns], [by, "input_truncated", *names])

    return x.mapInArrow(run, f"`{by}` {kind}, input_truncated boolean, {REPORT}")


def applied(diagnostics: DataFrame, told: DataFrame, by: str, order: str = "ordinal", after: int = 1 << 60) -> DataFrame:
    """diagnostics without those that an overriding plug-in suppresses (by target or action),
    and with those that plug-ins add, behind all others."""
    s = told.where("suppressed").select(F.col(by).alias("_by"), "labels", "patterns", "actions")
    hit = (F.coalesce(F.array_contains("labels", F.col("target")), F.lit(False)) | F.coalesce(F.exists("patterns", lambda p: F.regexp(F.col("target"), p)), F.lit(False))
           | F.coalesce(F.array_contains("actions", F.col("action")), F.lit(False)))
    kept = diagnostics.join(s, (F.col(by) == F.col("_by")) & hit, "left_anti")
    names = ("severity", "category", "message", "path", "line", "col_no", "target", "action", "repetition_count")
    new = told.select(by, F.posexplode("added").alias("_k", "_d")).select(by, (F.lit(after) + F.col("_k")).alias(order), *(F.col(f"_d.{c}").alias(c) for c in names))
    return kept.select(by, order, *names).unionByName(new)
