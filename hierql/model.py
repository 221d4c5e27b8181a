"""Event stores: logs, traces and events as DataFrames, and how names bind to their columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierql.functions.catalog import STANDARD, Scope, Type
from hierql.plans.ast import Attribute
from hierql.plans.compiler import Classifier

IDS = {Scope.LOG: ["log_id"], Scope.TRACE: ["log_id", "trace_id"], Scope.EVENT: ["log_id", "trace_id", "event_id"]}
ORDERS = {Scope.LOG: "log_order", Scope.TRACE: "trace_order", Scope.EVENT: "event_order"}

#: A custom attribute's value, tagged with its XES type; children are JSON.
VALUE = T.StructType([T.StructField(n, t) for n, t in (("t", T.StringType()), ("s", T.StringType()), ("d", T.DoubleType()), ("l", T.LongType()), ("b", T.BooleanType()), ("ts", T.TimestampType()), ("children", T.StringType()))])
ATTRS = T.MapType(T.StringType(), VALUE)


def physical(name: str) -> str:
    """Column name of an attribute."""
    return re.sub(r"\W", "_", name)


def union_value(value: Column, want: Type | None) -> Column:
    """A tagged value as the wanted type; as text if none is."""
    number = F.coalesce(value["d"], value["l"].cast("double"))
    if want in (Type.NUMBER, Type.INTEGER):
        return number
    if want == Type.DATETIME:
        return value["ts"]
    if want == Type.BOOLEAN:
        return value["b"]
    if want in (Type.STRING, Type.ID):
        return value["s"]
    return F.coalesce(value["s"], value["l"].cast("string"), value["d"].cast("string"), value["b"].cast("string"), value["ts"].cast("string"))


def as_type(c: Column, have: str, want: Type | None) -> Column:
    """A typed column as another type; null where it cannot be."""
    if want is None or want in (Type.UNKNOWN, Type.NULL) or have == want.sql:
        return c
    if want in (Type.NUMBER, Type.INTEGER) and have in ("int", "bigint", "smallint", "tinyint", "float") or want.sql == "string":
        return c.cast(want.sql)
    return c.try_cast(want.sql)


@dataclass
class Binding:
    """How a level's attributes are found: typed columns by name, else a map of tagged values."""

    standard: dict[str, str] = field(default_factory=dict)  # canonical name -> SQL expression over the level's frame
    custom: dict[str, str] = field(default_factory=dict)
    attrs: str | None = None

    def column(self, frame: DataFrame, a: Attribute, want: Type | None) -> Column:
        if a.kind == "system":
            return F.col("log_id").cast("string")
        found = (self.standard if a.kind == "standard" else self.custom).get(a.name)
        if found is not None:
            target = a.type if a.kind == "standard" else want
            return as_type(F.expr(found), frame.select(F.expr(found)).dtypes[0][1], target)
        if self.attrs is not None and a.kind == "custom":
            if a.path:
                parent, child = a.path
                found = F.from_json(F.col(self.attrs)[parent]["children"], "map<string,string>")[child]
                return F.when(found.startswith('{"'), F.get_json_object(found, "$.value")).otherwise(found)
            return union_value(F.col(self.attrs)[a.name], want)
        kind = a.type if a.kind == "standard" else want
        return F.lit(None).cast((kind or Type.STRING).sql)

    def all_columns(self, scope: Scope, frame: DataFrame) -> list[tuple[str, Column]]:
        """(output column, expression) of everything that a star selects."""
        kinds = {canonical: kind for _, canonical, kind in STANDARD[scope]}
        out = [(f"{scope.letter}_{physical(n)}", as_type(F.expr(e), frame.select(F.expr(e)).dtypes[0][1], kinds[n])) for n, e in self.standard.items()]
        out += [(f"{scope.letter}_{physical(n)}", F.expr(e)) for n, e in self.custom.items()]
        return out + ([(f"{scope.letter}_attrs", F.col(self.attrs))] if self.attrs else [])


def classifiers_in(header: dict) -> list[Classifier]:
    return [Classifier(c["name"], tuple(c["keys"]), Scope.TRACE if c["scope"] == "trace" else Scope.EVENT) for c in header.get("classifiers") or []]


@dataclass
class EventStore:
    """Three levels joined by ids; orders are explicit columns, never row order.

    logs (log_id, log_order), traces (log_id, trace_id, trace_order), events
    (log_id, trace_id, event_id, event_order), each with its attributes.
    """

    levels: dict[Scope, DataFrame]
    bindings: dict[Scope, Binding]
    classifiers: list[Classifier] = field(default_factory=list)
    headers: dict[str, dict] = field(default_factory=dict)  # by log id, of its XES document: extensions, classifiers, globals

    @property
    def header(self) -> dict:
        """The first log's header."""
        return next(iter(self.headers.values()), {})

    def header_of(self, log_id: str) -> dict:
        """A log's header; for groups of logs, which have no document of their own, the first log's."""
        return self.headers.get(log_id, self.header)

    def classifiers_of(self, log_id: str) -> list[Classifier]:
        """The classifiers of a log's own document, or all where it has none."""
        known = self.headers.get(log_id)
        return classifiers_in(known) if known is not None else self.classifiers

    @property
    def logs(self) -> DataFrame:
        return self.levels[Scope.LOG]

    @property
    def traces(self) -> DataFrame:
        return self.levels[Scope.TRACE]

    @property
    def events(self) -> DataFrame:
        return self.levels[Scope.EVENT]

    def only(self, log_id: str | None = None, logs: DataFrame | None = None) -> EventStore:
        """One log by its id, or the logs whose ids a frame holds; an id wins over a frame."""
        if log_id is not None:
            return replace(self, levels={s: df.where(F.col("log_id") == log_id) for s, df in self.levels.items()})
        if logs is None:
            return self
        ids = logs.select("log_id").distinct()
        return replace(self, levels={s: df.join(ids, "log_id", "left_semi") for s, df in self.levels.items()})

    def statistics(self) -> DataFrame:
        """(log_id, traces, events) of every log, zeros included."""
        counts = [self.levels[s].groupBy("log_id").agg(F.count(F.lit(1)).alias(f"{s.label}s")) for s in (Scope.TRACE, Scope.EVENT)]
        out = self.logs.select("log_id")
        for c in counts:
            out = out.join(c, "log_id", "left")
        return out.na.fill(0, ["traces", "events"])
