"""Deterministic synthetic logs, made where they are read."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hierql.functions.catalog import Scope
from hierql.model import Binding, EventStore
from hierql.plans.compiler import Classifier

from .adapters import one_log


def synthetic(
    spark: SparkSession,
    traces: int,
    events_per_trace: int = 10,
    attributes: int = 5,
    activities: int | None = None,
    variants: int | None = None,
    matching_percent: int | None = None,
    cost_cycle: int | None = None,
) -> EventStore:
    """One log of equally long traces, one event a minute.

    Activities repeat in order; with ``variants`` the first two events tell a
    trace's variant.  ``attr_1`` is ``hit`` in ``matching_percent`` of the traces,
    evenly spread, and ``out`` in the others.
    """
    count = activities or min(20, events_per_trace)
    cycle = cost_cycle or events_per_trace
    t, e = F.expr(f"id div {events_per_trace}"), F.col("id") % events_per_trace
    activity = e % count
    if variants:
        v = t % variants
        activity = F.when(e == 0, v % count).when(e == 1, F.expr(f"((id div {events_per_trace}) % {variants}) div {count}")).otherwise((e - 2) % count)
    columns = {f"attr_{i}": F.lit(f"v-{i}") for i in range(1, attributes + 1)}
    if matching_percent is not None:
        share = lambda n: F.floor(n * matching_percent / 100)
        columns["attr_1"] = F.when(share(t + 1) > share(t), "hit").otherwise("out")
    trace_id = lambda n: F.concat(F.lit("trace-"), (n + 1).cast("string"))
    events = spark.range(traces * events_per_trace).select(
        F.lit("synthetic").alias("log_id"),
        trace_id(t).alias("trace_id"),
        F.col("id").cast("string").alias("event_id"),
        e.alias("event_order"),
        F.concat(F.lit("activity-"), (activity + 1).cast("string")).alias("name"),
        F.timestamp_seconds(F.lit(1_577_836_800) + F.col("id") * 60).alias("ts"),
        ((e % cycle + 1) * 1.25).alias("total"),
        *[c.alias(n) for n, c in columns.items()],
    )
    rows = spark.range(traces).select(F.lit("synthetic").alias("log_id"), trace_id(F.col("id")).alias("trace_id"), F.col("id").alias("trace_order"))
    return EventStore(
        {Scope.LOG: one_log(spark, "synthetic"), Scope.TRACE: rows, Scope.EVENT: events},
        {Scope.LOG: Binding({"concept:name": "name"}), Scope.TRACE: Binding({"concept:name": "trace_id"}), Scope.EVENT: Binding({"concept:name": "name", "time:timestamp": "ts", "cost:total": "total"}, {n: n for n in columns})},
        [Classifier("Activity", ("concept:name",))],
    )
