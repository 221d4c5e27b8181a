"""Small event stores with hand-made contents."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from hierql.functions.catalog import Scope
from hierql.model import Binding, EventStore

START = datetime(2024, 1, 1, tzinfo=UTC)


def make_store(spark, logs, classifiers=()):
    """logs: list of (name, [(trace name, [event dict])]); event keys: name, total, ts (seconds), attr, resource."""
    log_rows, trace_rows, event_rows = [], [], []
    for i, (log, traces) in enumerate(logs):
        log_rows.append((log, i, log))
        for j, (trace, events, *more) in enumerate(traces):
            own = more[0] if more else {}
            trace_rows.append((log, f"{log}-{j}", j, trace, own.get("total"), own.get("currency")))
            for k, e in enumerate(events):
                ts = START + timedelta(seconds=e["ts"]) if e.get("ts") is not None else None
                event_rows.append((log, f"{log}-{j}", f"{log}-{j}-{k}", k, e.get("name"), e.get("total"), ts, e.get("attr"), e.get("resource"), e.get("currency")))
    frames = {
        Scope.LOG: spark.createDataFrame(log_rows, "log_id string, log_order long, name string"),
        Scope.TRACE: spark.createDataFrame(trace_rows, "log_id string, trace_id string, trace_order long, name string, total double, currency string"),
        Scope.EVENT: spark.createDataFrame(event_rows, "log_id string, trace_id string, event_id string, event_order long, name string, total double, ts timestamp, attr_1 string, resource string, currency string"),
    }
    bindings = {
        Scope.LOG: Binding({"concept:name": "name"}),
        Scope.TRACE: Binding({"concept:name": "name", "cost:total": "total", "cost:currency": "currency"}),
        Scope.EVENT: Binding({"concept:name": "name", "cost:total": "total", "time:timestamp": "ts", "org:resource": "resource", "cost:currency": "currency"}, {"attr_1": "attr_1"}),
    }
    return EventStore(frames, bindings, list(classifiers))


def hoist_logs():
    def trace(name, *pairs):
        return name, [{"name": f"E{i}", "total": float(v), "attr": a} for i, (v, a) in enumerate(pairs)]

    return [
        ("A", [trace("T0", (1, "hit"), (2, "out")), trace("T1", (3, "out"), (4, "out")), trace("T2", (5, "hit"), (6, "hit"))]),
        ("B", [trace("T0", (7, "hit"), (8, "out")), trace("T1", (9, "out"), (10, "out"))]),
    ]


def multi_logs():
    def trace(name, start, *events):
        return name, [{"name": e, "ts": start + i} for i, e in enumerate(events)]

    return [
        ("Alpha", [trace("Alpha-1", 1000, "Shared intake", "Alpha approval"), trace("Alpha-2", 1100, "Alpha archive")]),
        ("Beta", [trace("Beta-1", 0, "Shared intake", "Beta rejection")]),
    ]
