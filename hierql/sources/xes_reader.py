"""XES documents, plain or gzipped, as event stores.

A document is parsed in one streaming pass by the worker that reads it, which
keeps one trace at most; its rows of all three levels come out of that pass
tagged by level.  Documents are the unit of work: many of them are read at once.
Small ones come through Spark's binary files, others are streamed from the file
system.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from datetime import UTC, datetime
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hierql.functions.catalog import STANDARD, Scope
from hierql.model import ATTRS, Binding, EventStore, classifiers_in, physical

from .files import file_system, shared_file

SCALARS = ("string", "date", "int", "float", "boolean", "id")
#: Extensions whose attribute prefixes have a canonical spelling.
CANONICAL = {"Concept": "concept", "Identity": "identity", "Lifecycle": "lifecycle", "Time": "time", "Organizational": "org", "Cost": "cost"}
#: Attributes whose key starts with one of these are internal: neither read nor written.
HIDDEN: tuple[str, ...] = ()


class XesError(ValueError):
    """A document that is no valid XES."""


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_date(text: str) -> datetime | None:
    try:
        moment = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return moment.astimezone(UTC) if moment.tzinfo else moment.replace(tzinfo=UTC)


def typed(tag: str, text: str) -> dict:
    """A tagged value; text that does not parse stays a string."""
    value = dict.fromkeys(("t", "s", "d", "l", "b", "ts", "children"))
    value["t"] = tag
    try:
        if tag == "int":
            value["l"] = int(text)
        elif tag == "float":
            value["d"] = float(text)
        elif tag == "boolean" and text.strip().lower() in ("true", "false", "1", "0"):
            value["b"] = text.strip().lower() in ("true", "1")
        elif tag == "date" and (moment := parse_date(text)):
            value["ts"] = moment
        elif tag == "id":
            value["s"] = str(uuid.UUID(text))
        elif tag == "string":
            value["s"] = text
        else:
            raise ValueError
    except ValueError:
        value["t"], value["s"] = "string", text
    return value


def plain(value: dict):
    """A tagged value for JSON."""
    found = next((value[k] for k in ("s", "l", "d", "b", "ts") if value[k] is not None), None)
    return found.isoformat() if isinstance(found, datetime) else found


class Document:
    """One pass over a document; ``rows`` yields (level, trace index, event index, attributes)."""

    def __init__(self, stream):
        if not hasattr(stream, "peek"):
            stream = io.BufferedReader(stream)
        if stream.peek(2)[:2] == b"\x1f\x8b":
            stream = gzip.GzipFile(fileobj=stream)
        self.stream, self.prefixes = stream, {}
        self.header: dict = {"extensions": [], "classifiers": [], "globals": [], "version": None, "features": None}

    def rename(self, key: str) -> str:
        prefix, colon, rest = key.partition(":")
        return f"{self.prefixes[prefix]}:{rest}" if colon and prefix in self.prefixes else key

    def attribute(self, e: ElementTree.Element) -> tuple[str, dict] | None:
        tag, key = local(e.tag), e.get("key")
        if tag not in (*SCALARS, "list"):
            raise XesError(f"no attribute has the tag {tag}")
        if key is None:
            return None
        if tag == "list":
            lists = [v for v in e if local(v.tag) == "values"]
            tree = {"attributes": self.tree([c for c in e if local(c.tag) != "values"]), "values": [self.tree([c]) for v in lists for c in v]}
            value = {**dict.fromkeys(("t", "s", "d", "l", "b", "ts", "children")), "t": "list", "s": json.dumps(tree)}
        else:
            if any(local(c.tag) == "values" for c in e):
                raise XesError("values stand in a list only")
            value = typed(tag, e.get("value", ""))
            if len(e):
                value["children"] = json.dumps(self.tree(e))
        return self.rename(key), value

    def tree(self, elements) -> dict:
        out = {}
        for e in elements:
            if found := self.attribute(e):
                key, value = found
                out[key] = plain(value) if value["children"] is None else {"value": plain(value), "children": json.loads(value["children"])}
        return out

    def attributes(self, elements) -> dict[str, dict]:
        return dict(found for e in elements if (found := self.attribute(e)))

    def rows(self):
        header = self.header
        open_tags: list[str] = []
        elements: list[ElementTree.Element] = []
        own: list[ElementTree.Element] = []
        trace = event = -1
        seen_log = False
        try:
            for action, e in ElementTree.iterparse(self.stream, ("start", "end")):
                tag, depth = local(e.tag), len(open_tags)
                if action == "start":
                    if depth == 0:
                        if tag != "log":
                            raise XesError(f"a document starts with log, not {tag}")
                        seen_log = True
                        header["version"], header["features"] = e.get("xes.version"), e.get("xes.features")
                    elif tag == "trace" and open_tags == ["log"]:
                        trace, event = trace + 1, -1
                    elif tag == "event" and open_tags[-1] in ("trace", "log"):
                        if open_tags[-1] == "log":
                            raise XesError("events stand in a trace")
                        event += 1
                    elif tag in ("trace", "event", "log"):
                        raise XesError(f"{tag} stands inside {open_tags[-1]}")
                    open_tags.append(tag)
                    elements.append(e)
                    continue
                open_tags.pop()
                elements.pop()
                parent = open_tags[-1] if open_tags else None
                if tag == "event" and parent == "trace":
                    yield Scope.EVENT, trace, event, self.attributes(e)
                    elements[-1].remove(e)
                elif tag == "trace" and parent == "log":
                    yield Scope.TRACE, trace, -1, self.attributes(e)
                    elements[-1].remove(e)
                elif parent == "log":
                    if tag == "extension":
                        header["extensions"].append({k: e.get(k) for k in ("name", "prefix", "uri")})
                        if e.get("name") in CANONICAL and e.get("prefix") != CANONICAL[e.get("name")]:
                            self.prefixes[e.get("prefix")] = CANONICAL[e.get("name")]
                    elif tag == "classifier":
                        scope = self.scope(e)
                        header["classifiers"].append({"name": e.get("name"), "keys": (e.get("keys") or "").split(), "scope": scope})
                    elif tag == "global":
                        scope = self.scope(e)
                        header["globals"] += [{"scope": scope, "key": k, "value": v} for k, v in self.attributes(e).items()]
                    else:
                        own.append(e)
        except ElementTree.ParseError as error:
            raise XesError(str(error)) from None
        if not seen_log:
            raise XesError("a document holds one log")
        yield Scope.LOG, -1, -1, self.attributes(own)

    @staticmethod
    def scope(e: ElementTree.Element) -> str:
        scope = e.get("scope") or "event"
        if scope not in ("trace", "event"):
            raise XesError(f"no scope is called {scope}")
        return scope


_TAGGED = "level int, log_id string, log_order long, trace long, event long, attrs map<string,struct<t:string,s:string,d:double,l:bigint,b:boolean,ts:timestamp,children:string>>, header string"


#: Bytes up to which a document is read as one value.
WHOLE_BYTES = 64 << 20


def bare(path: str) -> str:
    """A local path without its scheme, other paths as they are."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def log_ids(files: list[str]) -> dict[str, str]:
    """A log's id is its file's name without suffixes; where names repeat, its path below their common folder."""

    def stem(path: str) -> str:
        for suffix in (".gz", ".xes", ".xml"):
            path = path.removesuffix(suffix)
        return path

    short = {f: stem(f.rpartition("/")[2]) for f in files}
    if len(set(short.values())) < len(files):
        folders = [f.split("/")[:-1] for f in files]
        common = 0
        while all(len(p) > common and p[common] == folders[0][common] for p in folders):
            common += 1
        short = {f: stem("/".join(f.split("/")[common:])) for f in files}
    if len(set(short.values())) < len(files):
        raise XesError("documents with the same path and different suffixes have no ids of their own")
    return short


def listed(files: DataFrame, paths: list[str]) -> list[str]:
    """The documents of a frame of files: in the order of the given paths, then by name."""
    found = sorted({bare(unquote(f)) for f in files.inputFiles()})
    given = [bare(p).rstrip("/") for p in paths]
    place = lambda f: next((i for i, p in enumerate(given) if f == p or f.startswith(p + "/")), len(given))
    return sorted(found, key=lambda f: (place(f), f))


def read_rows(spark: SparkSession, paths: list[str], whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Tagged rows of all documents; see ``log_ids`` for the logs' ids."""
    files = spark.read.format("binaryFile").load(paths)
    documents = listed(files, paths)
    ids, order = log_ids(documents), {f: i for i, f in enumerate(documents)}

    def parse(path: str, stream):
        import pandas as pd

        document, rows = Document(stream), []
        name, place = ids[bare(path)], order[bare(path)]
        for scope, trace, event, attributes in document.rows():
            header = None
            if scope == Scope.LOG:
                header = json.dumps(document.header, default=str)
                for key, canonical in (("version", "xes:version"), ("features", "xes:features")):
                    if document.header[key] is not None:
                        attributes.setdefault(canonical, typed("string", document.header[key]))
            rows.append((int(scope), name, place, trace, event, attributes, header))
            if len(rows) >= 5000:
                yield pd.DataFrame(rows, columns=_NAMES)
                rows = []
        yield pd.DataFrame(rows, columns=_NAMES)

    def whole(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield from parse(path, io.BytesIO(content))

    def streamed(batches):
        for batch in batches:
            for path in batch["path"]:
                system, place = file_system(path)
                with system.open_input_stream(place, compression=None, buffer_size=1 << 20) as stream:
                    yield from parse(path, io.BufferedReader(stream))

    small = files.where(F.col("length") <= whole_bytes).select("path", "content").mapInPandas(whole, _TAGGED)
    return small.unionByName(files.where(F.col("length") > whole_bytes).select("path").mapInPandas(streamed, _TAGGED))


_NAMES = [f.split()[0] for f in ("level int", "log_id string", "log_order long", "trace long", "event long", "attrs map", "header string")]


def custom_only(names: list[str]) -> Column:
    """The map of attributes without standard and hidden ones."""

    def shown(k: Column, _: Column) -> Column:
        keep = ~k.isin(names)
        for prefix in HIDDEN:
            keep = keep & ~k.startswith(prefix)
        return keep

    return F.map_filter("attrs", shown)


def store_of(rows: DataFrame, headers: list[tuple[str, dict]]) -> EventStore:
    """A store over tagged rows: standard attributes as columns, the others in a map."""
    levels, bindings = {}, {}
    for scope in Scope:
        own = rows.where(F.col("level") == int(scope))
        trace_id = F.concat_ws("-trace-", "log_id", "trace")
        ids = [F.col("log_id"), F.col("log_order")] if scope == Scope.LOG else [F.col("log_id"), trace_id.alias("trace_id"), F.col("trace").alias("trace_order")]
        if scope == Scope.EVENT:
            ids = [F.col("log_id"), trace_id.alias("trace_id"), F.concat_ws("-event-", trace_id, "event").alias("event_id"), F.col("event").alias("event_order")]
        columns = {}
        for _, canonical, kind in STANDARD[scope]:
            v = F.col("attrs")[canonical]
            text = F.coalesce(v["s"], v["l"].cast("string"), v["d"].cast("string"))
            columns[canonical] = F.coalesce(v["d"], v["l"].cast("double")) if kind.sql == "double" else v["ts"] if kind.sql == "timestamp" else text
        rest = custom_only(list(columns))
        levels[scope] = own.select(*ids, *[c.alias(physical(n)) for n, c in columns.items()], rest.cast(ATTRS).alias("attrs"))
        bindings[scope] = Binding({n: physical(n) for n in columns}, {}, "attrs")
    classifiers = [c for _, h in headers for c in classifiers_in(h)]
    return EventStore(levels, bindings, classifiers, dict(headers))


def read_xes(spark: SparkSession, paths: str | list[str], cache_to: str | None = None) -> EventStore:
    """The logs of XES documents.

    Documents are parsed once: their rows are written as Parquet to
    ``cache_to``, or else to the folder that driver and executors share.
    """
    from hierql.sources.shipping import ship

    ship(spark)
    rows = read_rows(spark, [paths] if isinstance(paths, str) else list(paths))
    cache_to = cache_to or shared_file(spark, "xes-rows")
    rows.write.mode("overwrite").partitionBy("level").parquet(cache_to)
    rows = spark.read.schema(rows.schema).parquet(cache_to)
    headers = [(r.log_id, json.loads(r.header)) for r in rows.where("header IS NOT NULL").select("log_id", "header", "log_order").orderBy("log_order", "log_id").collect()]
    return store_of(rows, headers)
