"""Ordinary tables as event stores: names bind to typed columns, nothing is copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hierql.functions.catalog import Scope
from hierql.model import Binding, EventStore
from hierql.plans.compiler import Classifier


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_log(spark: SparkSession, name: str) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("log_id"), F.col("id").alias("log_order"), F.lit(name).alias("name"))


def clickstream(spark: SparkSession, sf_dir: str) -> EventStore:
    """One log; users are traces, their events come by time."""
    rows = table(spark, sf_dir, "events")
    traces = rows.select("user_id").distinct().select(F.lit("events").alias("log_id"), F.col("user_id").cast("string").alias("trace_id"), F.col("user_id").alias("trace_order"))
    events = rows.select(
        F.lit("events").alias("log_id"),
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.struct("ts", F.col("event_id").alias("n")).alias("event_order"),
        "ts", "event_type", "value", "props",
    )
    return EventStore(
        {Scope.LOG: one_log(spark, "events"), Scope.TRACE: traces, Scope.EVENT: events},
        {
            Scope.LOG: Binding({"concept:name": "name"}),
            Scope.TRACE: Binding({"concept:name": "trace_id"}),
            Scope.EVENT: Binding({"concept:name": "event_type", "time:timestamp": "ts", "cost:total": "value", "identity:id": "event_id"}, {"k": "get_json_object(props, '$.k')"}),
        },
        [Classifier("Activity", ("concept:name",))],
    )


def orders(spark: SparkSession, sf_dir: str) -> EventStore:
    """Market segments are logs, orders their traces, order lines the events."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("log_id"))
    logs = customer.select("log_id").distinct().select("log_id", F.col("log_id").alias("log_order"))
    own = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    traces = own.select(
        "log_id", F.col("o_orderkey").cast("string").alias("trace_id"), F.col("o_orderkey").alias("trace_order"),
        "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate",
    )
    lines = table(spark, sf_dir, "lineitem").join(own.select("o_orderkey", "log_id"), F.col("l_orderkey") == F.col("o_orderkey"))
    events = lines.select(
        "log_id", F.col("l_orderkey").cast("string").alias("trace_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("event_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("event_order"),  # line numbers repeat within an order
        "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice", "l_suppkey", "l_quantity", "l_discount", "l_tax",
    )
    return EventStore(
        {Scope.LOG: logs, Scope.TRACE: traces, Scope.EVENT: events},
        {
            Scope.LOG: Binding({"concept:name": "log_id"}),
            Scope.TRACE: Binding({"concept:name": "trace_id", "cost:total": "o_totalprice"}, {c: c for c in ("o_orderpriority", "o_orderstatus", "o_orderdate")}),
            Scope.EVENT: Binding(
                {"concept:name": "concat(l_returnflag, l_linestatus)", "time:timestamp": "l_shipdate", "cost:total": "l_extendedprice", "org:resource": "l_suppkey"},
                {c: c for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")},
            ),
        },
        [Classifier("Flag", ("l_returnflag",)), Classifier("Status", ("l_returnflag", "l_linestatus"))],
    )


def dialogues(spark: SparkSession, sf_dir: str) -> EventStore:
    """One log; conversations are traces, turns their events."""
    rows = table(spark, sf_dir, "conversations")
    traces = rows.select("conv_id").distinct().select(F.lit("conversations").alias("log_id"), F.col("conv_id").cast("string").alias("trace_id"), F.col("conv_id").alias("trace_order"))
    events = rows.select(
        F.lit("conversations").alias("log_id"), F.col("conv_id").cast("string").alias("trace_id"), F.concat_ws("-", "conv_id", "turn").alias("event_id"), F.col("turn").alias("event_order"),
        "role", "text",
    )
    return EventStore(
        {Scope.LOG: one_log(spark, "conversations"), Scope.TRACE: traces, Scope.EVENT: events},
        {Scope.LOG: Binding({"concept:name": "name"}), Scope.TRACE: Binding({"concept:name": "trace_id"}), Scope.EVENT: Binding({"concept:name": "role"}, {"text": "text"})},
    )


def texts(spark: SparkSession, sf_dir: str) -> EventStore:
    """Languages are logs, their sources traces, documents the events; documents without a label have no quality."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    trace = F.concat_ws("-", "lang", "source").alias("trace_id")
    logs = rows.select("lang").distinct().select(F.col("lang").alias("log_id"), F.col("lang").alias("log_order"))
    traces = rows.select("lang", "source").distinct().select(F.col("lang").alias("log_id"), trace, F.col("source").alias("trace_order"), "source")
    events = rows.select(
        F.col("lang").alias("log_id"), trace, F.col("doc_id").cast("string").alias("event_id"), F.col("doc_id").alias("event_order"),
        "source", "text", "quality", F.col("n_chars").alias("size"), F.when(F.col("n_chars") > 2000, "yes").otherwise("no").alias("long"),
    )
    return EventStore(
        {Scope.LOG: logs, Scope.TRACE: traces, Scope.EVENT: events},
        {Scope.LOG: Binding({"concept:name": "log_id"}), Scope.TRACE: Binding({"concept:name": "source"}), Scope.EVENT: Binding({"concept:name": "source"}, {c: c for c in ("text", "quality", "size", "long")})},
        [Classifier("Quality", ("quality",))],
    )
