"""Named data stores of logs under one folder."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hierql.engine import DEFAULT_LIMITS, PqlResult, execute
from hierql.functions.catalog import Scope
from hierql.model import EventStore
from hierql.operators.delete import without
from hierql.plans.compiler import compile_query
from hierql.sources.shipping import ship
from hierql.sources.xes_reader import read_rows, store_of


def min_scope(pql: str, store: EventStore) -> Scope:
    """The scope that a delete query deletes."""
    return compile_query(pql, store.classifiers).delete


class Catalog:
    """Data stores and logs.

    ``logs/<log id>/<version>`` holds a log's rows as Parquet, ``catalog.json``
    the names, attachments and current versions.  A change writes new rows aside and
    then replaces the catalog file in one rename, so readers see all of it or
    nothing.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- the catalog file --

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> dict[str, dict]:
        fs, path = self._fs(), self._path("catalog.json")
        if not fs.exists(path):
            return {"stores": {}, "logs": {}}
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, state: dict) -> None:
        jvm, aside, to = self.spark._jvm, self._path(f"catalog-{uuid.uuid4().hex}.json"), self._path("catalog.json")
        out = self._fs().create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, to, options)

    @staticmethod
    def _now() -> str:
        return datetime.now(UTC).isoformat()

    # -- data stores --

    def create(self, name: str) -> dict[str, Any]:
        state, store = self._load(), str(uuid.uuid4())
        state["stores"][store] = {"id": store, "name": name, "created": self._now(), "updated": self._now(), "logs": []}
        self._save(state)
        return state["stores"][store]

    def list(self) -> list[dict[str, Any]]:
        return sorted(self._load()["stores"].values(), key=lambda s: (s["created"], s["id"]))

    def get(self, store: str) -> dict[str, Any]:
        return self._load()["stores"][store]

    def rename(self, store: str, name: str) -> dict[str, Any]:
        state = self._load()
        state["stores"][store] |= {"name": name, "updated": self._now()}
        self._save(state)
        return state["stores"][store]

    def remove(self, store: str) -> None:
        """Delete a data store with its logs."""
        state = self._load()
        for log in state["stores"].pop(store)["logs"]:
            state["logs"].pop(log, None)
            self._fs().delete(self._path(f"logs/{log}"), True)
        self._save(state)

    # -- logs --

    @staticmethod
    def generate_id() -> str:
        return f"log-{uuid.uuid4().hex[:8]}"

    def import_xes(self, store: str, path: str, log_id: str | None = None) -> str:
        """Read a document into a data store; its log appears once all rows are written."""
        state, log_id = self._load(), log_id or self.generate_id()
        if store not in state["stores"]:
            raise KeyError(f"no data store {store}")
        if log_id in state["logs"]:
            raise ValueError(f"log {log_id} exists")
        ship(self.spark)
        rows = read_rows(self.spark, [path]).withColumn("log_id", F.lit(log_id))
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/logs/{log_id}/{version}")
        own = self.spark.read.parquet(f"{self.root}/logs/{log_id}/{version}").where("header IS NOT NULL").first()
        state["logs"][log_id] = {"id": log_id, "version": version, "created": self._now(), "updated": self._now(), "header": json.loads(own.header), "attributes": {}}
        state["stores"][store]["logs"].append(log_id)
        self._save(state)
        return log_id

    def _rows(self, logs: list[dict]) -> DataFrame | None:
        out = None
        for n, log in enumerate(logs):
            rows = self.spark.read.parquet(f"{self.root}/logs/{log['id']}/{log['version']}").withColumn("log_order", F.lit(n).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def event_store(self, store: str | None = None, log_id: str | None = None) -> EventStore:
        """One log by its id, which wins; else the logs of a data store in order of creation; else all."""
        state = self._load()
        ids = [log_id] if log_id is not None else state["stores"][store]["logs"] if store is not None else list(state["logs"])
        logs = sorted((state["logs"][i] for i in ids if i in state["logs"]), key=lambda x: (x["created"], x["id"]))
        rows = self._rows(logs)
        if rows is None:
            rows = self.spark.createDataFrame([], "level int, log_id string, log_order long, trace long, event long, attrs map<string,struct<t:string,s:string,d:double,l:bigint,b:boolean,ts:timestamp,children:string>>, header string")
        return store_of(rows, [(log["id"], log["header"]) for log in logs])

    def query(self, pql: str, store: str | None = None, log_id: str | None = None, default_limits: dict[Scope, int] | None = None) -> PqlResult:
        """Run a read query; in a data store the default caps hold, as for ``DEFAULT_LIMITS``."""
        limits = default_limits if default_limits is not None else DEFAULT_LIMITS if store is not None and log_id is None else {}
        return execute(self.event_store(store, log_id), pql, limits=limits)

    def delete(self, pql: str, store: str | None = None, log_id: str | None = None) -> int:
        """Run a delete query; the number of deleted components."""
        before = self.event_store(store, log_id)
        after, gone = without(before, pql)
        counts = {scope: rows.groupBy("log_id").count() for scope, rows in gone.levels.items() if scope >= min_scope(pql, before)}
        total, touched, lost = 0, set(), set()
        for scope, rows in counts.items():
            for r in rows.collect():  # a row per log
                total += r["count"]
                (lost if scope == Scope.LOG else touched).add(r.log_id)
        if not total:
            return 0
        state, old = self._load(), []
        for log in lost:
            self._drop(state, log)
            old.append(f"logs/{log}")
        for log in sorted(touched - lost):
            rows = self._rows([state["logs"][log]])
            trace_id = F.concat_ws("-trace-", "log_id", "trace")
            keep_traces = after.traces.where(F.col("log_id") == log).select(F.col("trace_order").alias("trace"))
            keep_events = after.events.where(F.col("log_id") == log).select("trace_id", F.col("event_order").alias("event"))
            parts = [
                rows.where("level = 0"),
                rows.where("level = 1").join(keep_traces, "trace", "left_semi"),
                rows.where("level = 2").withColumn("trace_id", trace_id).join(keep_events, ["trace_id", "event"], "left_semi").drop("trace_id"),
            ]
            version, entry = uuid.uuid4().hex, state["logs"][log]
            parts[0].unionByName(parts[1]).unionByName(parts[2]).write.parquet(f"{self.root}/logs/{log}/{version}")
            if entry.get("previous"):
                old.append(f"logs/{log}/{entry['previous']}")
            entry |= {"version": version, "previous": entry["version"], "updated": self._now()}
        self._save(state)
        for path in old:  # the version before stays for readers that began with it
            self._fs().delete(self._path(path), True)
        return total

    @staticmethod
    def _drop(state: dict, log_id: str) -> None:
        state["logs"].pop(log_id)
        for s in state["stores"].values():
            s["logs"] = [x for x in s["logs"] if x != log_id]

    def delete_log(self, log_id: str) -> None:
        state = self._load()
        self._drop(state, log_id)
        self._save(state)
        self._fs().delete(self._path(f"logs/{log_id}"), True)

    def update_log(self, log_id: str, attributes: dict[str, str]) -> dict[str, Any]:
        """Replace a log's catalog attributes."""
        state = self._load()
        state["logs"][log_id] |= {"attributes": dict(attributes), "updated": self._now()}
        self._save(state)
        return state["logs"][log_id]

    def statistics(self, store: str | None = None) -> DataFrame:
        """(log_id, traces, events) of every log, zeros included."""
        return self.event_store(store).statistics()

    def log_summaries(self, store: str) -> DataFrame:
        """(log_id, name, traces, events) of a data store's logs."""
        return self.event_store(store).logs.select("log_id", F.col("concept_name").alias("name")).join(self.statistics(store), "log_id")

    def search(self, name: str | None = None, attribute: tuple[str, str] | None = None, created_from: datetime | None = None, created_to: datetime | None = None) -> list[str]:
        """Ids of logs by the first given criterion: part of the name, attribute, time of creation."""
        logs = self._load()["logs"]
        if name is not None:
            names = self.event_store().logs.where(F.contains(F.lower("concept_name"), F.lit(name.lower())))
            return sorted(r.log_id for r in names.select("log_id").collect())
        if attribute is not None:
            return sorted(i for i, x in logs.items() if x["attributes"].get(attribute[0]) == attribute[1])
        if created_from is not None and created_to is not None:
            return sorted(i for i, x in logs.items() if created_from <= datetime.fromisoformat(x["created"]) <= created_to)
        if created_from is not None:
            return sorted(i for i, x in logs.items() if datetime.fromisoformat(x["created"]) > created_from)
        return sorted(logs)
