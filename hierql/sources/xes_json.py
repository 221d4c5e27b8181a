"""Results as XES JSON: attributes grouped by tag as @key and @value, sorted by key."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import functions as F

from hierql.engine import PqlResult
from hierql.functions.catalog import Scope
from hierql.model import classifiers_in
from hierql.plans.compiler import Classifier

from .rendering import CLOSES, INSIDE, OPENS, Component, Value, component, keys, logs
from .xes_writer import write_each


def json_text(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime):
        moment = value.astimezone(UTC) if value.tzinfo else value
        text, fraction = moment.strftime("%Y-%m-%dT%H:%M:%S"), moment.microsecond
        digits = f".{fraction // 1000:03d}" if fraction and fraction % 1000 == 0 else f".{fraction:06d}" if fraction else ""
        return f"{text}{digits}Z"
    return value.isoformat() if isinstance(value, date) else str(value)


def single(items: list) -> Any:
    return items[0] if len(items) == 1 else items


def attribute_view(c: Component) -> dict[str, Any]:
    by_tag: dict[str, list[dict[str, str]]] = {}
    for key in sorted(c.attributes):
        v = c.attributes[key]
        by_tag.setdefault("string" if v.tag == "list" else v.tag, []).append({"@key": key, "@value": json_text(v.value)})
    return {tag: single(items) for tag, items in by_tag.items()}


def synthetic_id(c: Component) -> str:
    """A stable id of a log without one."""
    seed = ";".join(f"{k}={json_text(v.value)}" for k, v in sorted(c.attributes.items()))
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"log:{seed}"))


def head(header: dict, classifiers: list[Classifier], own: Component, whole: bool) -> dict[str, Any]:
    """A log's document without its traces."""
    out: dict[str, Any] = {"@xes.version": "1.0", "@xmlns": "http://www.xes-standard.org/"}
    if header.get("extensions"):
        out["extension"] = [{f"@{k}": e[k] for k in ("name", "prefix", "uri")} for e in header["extensions"]]
    if whole and header.get("globals"):
        out["global"] = [global_view(header["globals"], s) for s in ("trace", "event") if any(g["scope"] == s for g in header["globals"])]
    if classifiers:
        out["classifier"] = [{"@name": c.name, "@scope": c.scope.label, "@keys": " ".join(c.keys)} for c in classifiers]
    own = Component({k: v for k, v in own.attributes.items() if k not in ("xes:version", "xes:features", "db:id")})
    if whole and "identity:id" not in own.attributes:
        own.attributes["identity:id"] = Value("id", synthetic_id(own))
    return out | attribute_view(own)


def trace_view(trace: Component, inner: list[Component], nulls: int, events: bool, whole: bool) -> dict[str, Any]:
    view: dict[str, Any] = attribute_view(trace)
    if events:
        listed = [attribute_view(e) or None for e in inner] or [None] * nulls
        if listed or whole:
            view["event"] = single(listed) if listed else None
    return view


def to_json(result: PqlResult, traces: bool = True, events: bool = True) -> Iterator[dict]:
    """One document per log; events imply traces."""
    whole = Scope.LOG in result.plan.stars
    for log in logs(result, traces or events, events):
        out = head(result.store.header_of(log.log_id), result.store.classifiers_of(log.log_id), log.own, whole)
        found = [trace_view(trace, inner, nulls, events, whole) for trace, inner, nulls in log.traces]
        if found:
            out["trace"] = single(found)
        yield {"log": out}


def to_json_each(result: PqlResult, folder: str) -> list[str]:
    """Write the documents of ``to_json``, each to a file of one line; the files' paths.

    Executors write them, a trace at a time; the driver has the names of files only.
    """
    store, names, whole = result.store, {s: keys(result, s) for s in Scope}, Scope.LOG in result.plan.stars
    headers, other, classifiers = store.headers, store.header, store.classifiers

    def write(out, row: dict) -> None:
        if row["_at"] == OPENS:
            known = classifiers_in(headers[row["log_id"]]) if row["log_id"] in headers else classifiers
            view = head(headers.get(row["log_id"], other), known, component(row["own"], names[Scope.LOG], "l_attrs"), whole)
            out.write(json.dumps({"log": view})[:-2])
            if row["_n"]:
                out.write(', "trace": ' + "[" * (row["_n"] > 1))
        elif row["_at"] == CLOSES:
            out.write("]" * (row["_n"] > 1) + "}}\n")
        else:
            trace = row["trace"]
            found = [component(e, names[Scope.EVENT], "e_attrs") for e in trace.get("events") or ()]
            view = trace_view(component(trace, names[Scope.TRACE], "t_attrs"), found, trace.get("_null_event_count") or 0, True, whole)
            out.write(", " * (not row["_first"]) + json.dumps(view))

    own, below = result.logs, result.trace_rows()
    place = F.struct("_pos", "trace_id")
    counts = below.groupBy("log_id").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_least"))
    places = own.select("log_id", F.col("_pos").alias("_log_pos")).join(counts, "log_id")
    inside = below.select("log_id", place.alias("_place"), F.struct(*[c for c in below.columns if c != "_pos"]).alias("trace"))
    inside = inside.join(places, "log_id").select("log_id", "_log_pos", F.lit(INSIDE).alias("_at"), "_place", (F.col("_place") == F.col("_least")).alias("_first"), "trace")
    ends = own.select("log_id", F.col("_pos").alias("_log_pos"), F.struct(*[c for c in own.columns if c != "_pos"]).alias("own"), F.explode(F.array(F.lit(OPENS), F.lit(CLOSES))).alias("_at"))
    ends = ends.join(counts.select("log_id", "_n"), "log_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rows = ends.unionByName(inside, allowMissingColumns=True).orderBy("_log_pos", "log_id", "_at", "_place").drop("_place")
    return write_each(rows, write, folder, ".json", False)


def global_view(found: list[dict], scope: str) -> dict:
    own = {g["key"]: Value(g["value"]["t"], next((g["value"][k] for k in ("s", "l", "d", "b", "ts") if g["value"][k] is not None), None)) for g in found if g["scope"] == scope}
    return {"@scope": scope} | attribute_view(Component(own))
