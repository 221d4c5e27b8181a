"""Running queries over an event store."""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hierql.errors import PqlError
from hierql.functions.catalog import AGGREGATES, SCALARS, Scope
from hierql.model import IDS, EventStore
from hierql.operators.lowering import LevelResult, Lowering
from hierql.plans.compiler import Plan, compile_query

#: Windows of interactive reads: at most so many logs, traces a log, events a trace.
DEFAULT_LIMITS = {Scope.LOG: 10, Scope.TRACE: 30, Scope.EVENT: 90}


@dataclass
class PqlResult:
    """One DataFrame per level, with ids, ``_pos`` and the projected columns."""

    levels: dict[Scope, LevelResult]
    plan: Plan
    store: EventStore
    lowering: Lowering

    @property
    def logs(self) -> DataFrame:
        return self.levels[Scope.LOG].frame

    @property
    def traces(self) -> DataFrame:
        return self.levels[Scope.TRACE].frame

    @property
    def events(self) -> DataFrame:
        return self.levels[Scope.EVENT].frame

    def placeholders(self) -> DataFrame:
        """Traces with ``_null_event_count``: how many empty events stand for those that the query does not show."""
        if "_null_event_count" in self.traces.columns:
            return self.traces
        if self.shown(Scope.EVENT):
            return self.traces.withColumn("_null_event_count", F.lit(0).cast("long"))
        return self.traces.join(self.lowering.null_events(self.traces.select(*IDS[Scope.TRACE])), IDS[Scope.TRACE])

    def names(self, scope: Scope) -> dict[str, str]:
        """Output column -> canonical text of its expression."""
        return self.levels[scope].names

    def shown(self, scope: Scope) -> bool:
        return scope in self.plan.stars or any(c.scope == scope for c in self.plan.columns)

    def flat(self) -> DataFrame:
        """One row per row of the deepest shown level, with the projected columns of its parents."""
        deepest = max((s for s in Scope if self.shown(s)), default=Scope.LOG)
        out = self.levels[deepest].frame.withColumnRenamed("_pos", f"_{deepest.letter}_pos")
        for s in range(deepest - 1, -1, -1):
            scope = Scope(s)
            above = self.levels[scope].frame
            above = above.drop("_trace_count", "_null_event_count").withColumnRenamed("_pos", f"_{scope.letter}_pos")
            out = out.join(above, IDS[scope])
        return out

    def trace_rows(self, events: bool = True) -> DataFrame:
        """Traces, each with its ``events`` in order."""
        if not events:
            return self.traces.drop("_null_event_count")
        if not self.shown(Scope.EVENT):  # empty events stand for those that the query does not show
            return self.placeholders().withColumn("events", F.lit(None).cast("array<struct<_pos:bigint>>")).withColumn("events", F.coalesce("events", F.array()))
        below = self.traces
        own = self.events
        item = F.struct("_pos", *[c for c in own.columns if c not in ("_pos", "log_id", "trace_id")])
        lists = self._sorted(own, IDS[Scope.TRACE], item, "events")
        return below.join(lists, IDS[Scope.TRACE], "left").withColumn("events", F.coalesce("events", F.array()))

    def nested(self, traces: bool = True, events: bool = True) -> DataFrame:
        """One row per log: its columns and ``traces``, each with ``events``, in order."""
        if not (traces or events):
            return self.logs
        below = self.trace_rows(events)
        item = F.struct("_pos", *[c for c in below.columns if c not in ("_pos", "log_id")])
        return self.logs.join(self._sorted(below, ["log_id"], item, "traces"), "log_id", "left").withColumn("traces", F.coalesce("traces", F.array()))

    @staticmethod
    def _sorted(rows: DataFrame, by: list[str], item, name: str) -> DataFrame:
        """Lists in order of ``_pos``; the other fields may hold maps, which have no order."""
        lists = rows.groupBy(*by).agg(F.collect_list(item).alias(name))
        return lists.withColumn(name, F.array_sort(name, lambda a, b: F.when(a["_pos"] < b["_pos"], -1).when(a["_pos"] > b["_pos"], 1).otherwise(0)))


@contextmanager
def utc(spark: SparkSession):
    """Expressions that are built inside compute in UTC, whatever the session's time zone."""
    name = "spark.sql.session.timeZone"
    before = spark.conf.get(name)
    spark.conf.set(name, "UTC")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def execute(store: EventStore, query: str, log_id: str | None = None, limits: dict[Scope, int] | None = None, now: datetime | None = None, fan_out: bool = False) -> PqlResult:
    """Run a read query; ``limits`` are caps that the query's own limits can only lower.

    With ``fan_out`` a query with classifiers over several logs keeps its own
    limit of logs, or none, in place of the cap.
    """
    if log_id is not None:
        store = store.only(log_id)
    plan = compile_query(query, store.classifiers)
    if plan.delete is not None:
        raise ValueError("a delete query cannot be executed as a read; use delete()")
    uses_classifiers = any(k.kind == "classifier" for k in plan.group_by) or bool(re.search(r"\b(c|classifier):", query))
    for scope, n in (limits or {}).items():
        if fan_out and scope == Scope.LOG and uses_classifiers:
            continue
        plan.limits[scope] = min(n, plan.limits.get(scope, n))
    with utc(store.logs.sparkSession):
        lowering = Lowering(store, plan, now)
        return PqlResult(lowering.results(), plan, store, lowering)


def validate(query: str, store: EventStore | None = None) -> list[PqlError]:
    """The query's problems: none, or the first."""
    try:
        compile_query(query, store.classifiers if store else ())
    except PqlError as e:
        return [e]
    return []


def features() -> dict[str, list[str]]:
    """What the language offers."""
    return {
        "clauses": ["select", "delete", "where", "group by", "order by", "limit", "offset"],
        "scopes": [s.label for s in Scope],
        "operators": ["=", "!=", "<", "<=", ">", ">=", "and", "or", "not", "in", "not in", "like", "matches", "is null", "is not null", "+", "-", "*", "/"],
        "aggregates": list(AGGREGATES),
        "functions": ["now", *SCALARS],
    }
