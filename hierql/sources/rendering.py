"""Results as components with XES attributes: streamed trace by trace to the driver, or as one sorted frame of pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from hierql.engine import PqlResult
from hierql.functions.catalog import Scope
from hierql.model import IDS, physical
from hierql.plans.ast import Attribute

from .xes_reader import HIDDEN


@dataclass
class Value:
    """A value with its XES tag; children are a tree of nested attributes."""

    tag: str
    value: Any
    children: dict | None = None


@dataclass
class Component:
    attributes: dict[str, Value] = field(default_factory=dict)
    row: Row | None = None


def tag_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return "date" if isinstance(value, (datetime, date)) else "string"


def keys(result: PqlResult, scope: Scope) -> dict[str, tuple[str, bool]]:
    """Output column -> (XES key, computed) of a level."""
    out: dict[str, tuple[str, bool]] = {}
    if scope in result.plan.stars:
        binding = result.store.bindings[scope]
        out = {f"{scope.letter}_{physical(n)}": (n, False) for n in (*binding.standard, *binding.custom)}
    for c in result.plan.columns:
        if c.scope == scope and c.alias not in out:
            plain = isinstance(c.expression, Attribute)
            out[c.alias] = (c.expression.name if plain else c.text, not plain)
    return out


def component(row: Row | dict, names: dict[str, tuple[str, bool]], attrs: str) -> Component:
    """Nulls of plain attributes are left out, those of computed columns stay; hidden keys go."""
    out = Component(row=row)
    for column, (key, computed) in names.items():
        value = row[column]
        if (value is not None or computed) and not key.startswith(HIDDEN):
            out.attributes[key] = Value("id" if key == "identity:id" else tag_of(value), value)
    if attrs in row:
        for key, v in dict(row[attrs] or {}).items():
            value = next((v[k] for k in ("s", "l", "d", "b", "ts") if v[k] is not None), None)
            out.attributes.setdefault(key, Value(v["t"], value, json.loads(v["children"]) if v["children"] else None))
    return out


@dataclass
class Log:
    log_id: str
    own: Component
    traces: Iterator[tuple[Component, list[Component], int]]  # trace, events, empty events


def logs(result: PqlResult, traces: bool = True, events: bool = True) -> Iterator[Log]:
    """Logs in order, each with its traces, whose events come with them.

    Two sorted streams from Spark, of logs and of the traces of all of them, are
    merged: one trace is held at a time, and a log's traces are to be taken before the next log.
    """
    names = {s: keys(result, s) for s in Scope}
    own = result.logs.withColumnRenamed("_pos", "_log_pos")
    order = ["_log_pos", *IDS[Scope.LOG]]
    below = iter(())
    if traces or events:
        found = result.trace_rows(events).join(own.select("log_id", "_log_pos"), "log_id").orderBy(*order, "_pos")
        below = (row.asDict() for row in found.toLocalIterator())
    waiting = next(below, None)

    def of_log(log_id: str):
        nonlocal waiting
        while waiting is not None and waiting["log_id"] == log_id:
            row, waiting = waiting, next(below, None)
            found = [component(e.asDict(), names[Scope.EVENT], "e_attrs") for e in row.get("events") or ()]
            yield component(row, names[Scope.TRACE], "t_attrs"), found, row.get("_null_event_count") or 0

    for row in own.orderBy(*order).toLocalIterator():
        row = row.asDict()
        mine = of_log(row["log_id"])
        yield Log(row["log_id"], component(row, names[Scope.LOG], "l_attrs"), mine)
        for _ in mine:  # traces that the caller left
            pass


#: What ``pieces`` are sorted by.
PIECE_ORDER = ["_log_pos", "log_id", "_at", "_trace_pos", "trace_id", "_in", "_event_pos", "event_id"]
OPENS, INSIDE, CLOSES = 0, 1, 2


def pieces(result: PqlResult, names: dict[Scope, dict[str, tuple[str, bool]]]) -> DataFrame:
    """The result in the order of a document, one row for each event and two for each trace and log, which open and close it.

    ``_at`` tells where in its log a row is, ``_in`` where in its trace; ``own``,
    ``trace`` and ``event`` hold a component's columns.  Rows stand for themselves,
    so a frame may be cut anywhere, also inside of a trace.
    """

    def fields(frame: DataFrame, scope: Scope):
        return F.struct("log_id", *[c for c in frame.columns if c in names[scope] or c == f"{scope.letter}_attrs"])

    ends = F.explode(F.array(F.lit(OPENS), F.lit(CLOSES)))
    logs = result.logs
    logs = logs.select(F.col("_pos").alias("_log_pos"), "log_id", fields(logs, Scope.LOG).alias("own"), ends.alias("_at"))
    places = result.logs.select("log_id", F.col("_pos").alias("_log_pos"))
    shown = result.shown(Scope.EVENT)
    traces = result.traces if shown else result.placeholders()  # empty events stand for those that the query does not show
    nulls = F.coalesce("_null_event_count", F.lit(0)) if "_null_event_count" in traces.columns else F.lit(0)
    traces = traces.select(*IDS[Scope.TRACE], F.col("_pos").alias("_trace_pos"), F.lit(INSIDE).alias("_at"), fields(traces, Scope.TRACE).alias("trace"), nulls.cast("long").alias("_nulls"))
    traces = traces.join(places, "log_id")
    out = logs.unionByName(traces.withColumn("_in", ends), allowMissingColumns=True)
    if shown:
        events = result.events
        events = events.select(*IDS[Scope.EVENT], F.col("_pos").alias("_event_pos"), F.lit(INSIDE).alias("_in"), fields(events, Scope.EVENT).alias("event"))
        events = events.join(traces.select(*IDS[Scope.TRACE], "_log_pos", "_trace_pos", "_at"), IDS[Scope.TRACE])
        out = out.unionByName(events, allowMissingColumns=True)
    else:
        out = out.withColumns({"_event_pos": F.lit(None).cast("long"), "event_id": F.lit(None).cast("string"), "event": F.struct("log_id")})
    return out.orderBy(*PIECE_ORDER)
