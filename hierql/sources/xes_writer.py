"""Results as XES documents: XML, gzip, zip."""

from __future__ import annotations

import gzip
import io
import json
import shutil
import uuid
import zipfile
from collections.abc import Callable
from contextlib import ExitStack, contextmanager, nullcontext
from datetime import UTC, date, datetime
from typing import Any
from urllib.parse import quote as quote_path
from xml.sax.saxutils import quoteattr

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from hierql.engine import PqlResult
from hierql.functions.catalog import Scope
from hierql.model import classifiers_in
from hierql.plans.compiler import Classifier

from .files import file_system, open_output
from .rendering import CLOSES, OPENS, Component, Log, Value, component, keys, logs, pieces
from .xes_reader import CANONICAL

#: Extensions of a log that names none.
DEFAULT_EXTENSIONS = [(name, prefix, f"http://www.xes-standard.org/{prefix}.xesext") for name, prefix in CANONICAL.items()]
DECLARATION = '<?xml version="1.0" encoding="UTF-8" ?>\n'
LOG_OPEN = '<log xes.version="1.0" xes.features="nested-attributes" xmlns="http://www.xes-standard.org/">\n'
LOG_CLOSE = "</log>\n"
_ILLEGAL = dict.fromkeys([*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF])


def quote(text: str) -> str:
    return quoteattr(text.translate(_ILLEGAL), {"\n": "&#10;", "\r": "&#13;", "\t": "&#9;"})


def xml_text(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime):
        moment = value.astimezone(UTC) if value.tzinfo else value
        return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"
    return value.isoformat() if isinstance(value, date) else str(value)


class Emitter:
    """Writes attributes; standard keys get the prefixes of the log's extensions."""

    def __init__(self, out, extensions: list[dict]):
        self.out = out
        self.prefixes = {CANONICAL[e["name"]]: e["prefix"] for e in extensions if e["name"] in CANONICAL and e["prefix"]}

    def key(self, key: str) -> str:
        prefix, colon, rest = key.partition(":")
        return f"{self.prefixes[prefix]}:{rest}" if colon and prefix in self.prefixes else key

    def attribute(self, key: str, v: Value, indent: str) -> None:
        if v.tag == "list":
            tree = json.loads(v.value)
            self.out.write(f"{indent}<list key={quote(self.key(key))}>\n")
            self.children(tree["attributes"], indent + "\t")
            self.out.write(f"{indent}\t<values>\n")
            for one in tree["values"]:
                self.children(one, indent + "\t\t")
            self.out.write(f"{indent}\t</values>\n{indent}</list>\n")
            return
        head = f"{indent}<{v.tag} key={quote(self.key(key))} value={quote(xml_text(v.value))}"
        if v.children:
            self.out.write(head + ">\n")
            self.children(v.children, indent + "\t")
            self.out.write(f"{indent}</{v.tag}>\n")
        else:
            self.out.write(head + "/>\n")

    def children(self, tree: dict, indent: str) -> None:
        for key, value in tree.items():
            if isinstance(value, dict) and "children" in value:
                self.attribute(key, Value(tag_of_json(value["value"]), value["value"], value["children"]), indent)
            else:
                self.attribute(key, Value(tag_of_json(value), value), indent)

    def all(self, c: Component, indent: str) -> None:
        for key, v in c.attributes.items():
            self.attribute(key, v, indent)


def tag_of_json(value: Any) -> str:
    return "boolean" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "string"


def write_xes(result: PqlResult, out, log_name: str = "log", traces: bool = True, events: bool = True) -> None:
    """Write the result's logs to a text stream, trace by trace, each with the header of its own document.

    Several logs follow each other in it; ``to_xes_each`` gives each a document of its own.
    """
    out.write(DECLARATION)
    empty = True
    for log in logs(result, traces, events):
        empty = False
        write_log(result, log, out, log_name)
    if empty:
        emit, extensions = opened(result.store.header, out)
        out.write(LOG_OPEN)
        write_extensions(out, extensions)
        emit.attribute("concept:name", Value("string", log_name), "\t")
        out.write(LOG_CLOSE)


def opened(header: dict, out) -> tuple[Emitter, list]:
    """What writes attributes under a header, and the header's extensions."""
    extensions = [(e["name"], e["prefix"], e["uri"]) for e in header.get("extensions") or []] or DEFAULT_EXTENSIONS
    return Emitter(out, header.get("extensions") or []), extensions


def write_log(result: PqlResult, log: Log, out, log_name: str) -> None:
    emit = open_log(result.store.header_of(log.log_id), result.store.classifiers_of(log.log_id), log.own, out, log_name)
    for trace, found, nulls in log.traces:
        open_trace(emit, trace)
        for e in found:
            write_event(emit, e)
        close_trace(emit, nulls)
    out.write(LOG_CLOSE)


def open_log(header: dict, classifiers: list[Classifier], own: Component, out, log_name: str) -> Emitter:
    """Write a log up to its traces; what writes these."""
    emit, extensions = opened(header, out)
    out.write(LOG_OPEN)
    write_extensions(out, extensions)
    for scope in ("trace", "event"):
        found = [g for g in header.get("globals") or [] if g["scope"] == scope]
        if found:
            out.write(f'\t<global scope="{scope}">\n')
            for g in found:
                value = next((g["value"][k] for k in ("s", "l", "d", "b", "ts") if g["value"][k] is not None), None)
                emit.attribute(g["key"], Value(g["value"]["t"], value), "\t\t")
            out.write("\t</global>\n")
    for c in classifiers:
        out.write(f'\t<classifier name={quote(c.name)} scope="{c.scope.label}" keys={quote(" ".join(c.keys))}/>\n')
    attributes = {k: v for k, v in own.attributes.items() if k not in ("xes:version", "xes:features")}
    attributes.setdefault("concept:name", Value("string", log_name))
    emit.all(Component(attributes), "\t")
    return emit


def open_trace(emit: Emitter, trace: Component) -> None:
    emit.out.write("\t<trace>\n")
    emit.all(trace, "\t\t")


def write_event(emit: Emitter, event: Component) -> None:
    emit.out.write("\t\t<event>\n")
    emit.all(event, "\t\t\t")
    emit.out.write("\t\t</event>\n")


def close_trace(emit: Emitter, nulls: int) -> None:
    emit.out.write("\t\t<event/>\n" * nulls + "\t</trace>\n")


def write_extensions(out, extensions) -> None:
    for name, prefix, uri in extensions:
        out.write(f"\t<extension name={quote(name or '')} prefix={quote(prefix or '')} uri={quote(uri or '')}/>\n")


@contextmanager
def text_output(path: str, compress: bool):
    """A text stream to a file, local or at a URI, gzipped if asked to."""
    with open_output(path) as raw, gzip.GzipFile(fileobj=raw, mode="wb") if compress else nullcontext(raw) as packed, io.TextIOWrapper(io.BufferedWriter(Unclosed(packed), 1 << 20), "utf-8", newline="\n") as out:
        yield out


def to_xes(result: PqlResult, path: str, compress: bool = False, log_name: str = "log") -> None:
    """Write a document."""
    with text_output(path, compress) as out:
        write_xes(result, out, log_name)


def to_xes_each(result: PqlResult, folder: str, compress: bool = False, log_name: str = "log") -> list[str]:
    """Write a document for every log, named by the log's id; the documents' paths.

    Executors sort the rows and write them; the driver has the names of files only.
    """
    store, names = result.store, {s: keys(result, s) for s in Scope}
    headers, other, classifiers = store.headers, store.header, store.classifiers

    def write(out, row: dict) -> None:
        header = headers.get(row["log_id"], other)
        if row["_at"] == OPENS:
            out.write(DECLARATION)
            known = classifiers_in(headers[row["log_id"]]) if row["log_id"] in headers else classifiers
            open_log(header, known, component(row["own"], names[Scope.LOG], "l_attrs"), out, log_name)
        elif row["_at"] == CLOSES:
            out.write(LOG_CLOSE)
        elif row["_in"] == OPENS:
            open_trace(opened(header, out)[0], component(row["trace"], names[Scope.TRACE], "t_attrs"))
        elif row["_in"] == CLOSES:
            close_trace(opened(header, out)[0], row["_nulls"])
        else:
            write_event(opened(header, out)[0], component(row["event"], names[Scope.EVENT], "e_attrs"))

    return write_each(pieces(result, names), write, folder, ".xes" + ".gz" * compress, compress)


def write_each(rows: DataFrame, write: Callable, folder: str, suffix: str, compress: bool) -> list[str]:
    """Write a document of every log's ``pieces`` with ``write(out, row)``; the documents' paths.

    Every task writes its stretch of a log to a part, then one task a log puts
    its parts together.  Gzipped parts are members of one gzip file.
    """
    from .shipping import ship

    spark, aside = rows.sparkSession, f"{folder.rstrip('/')}/parts-{uuid.uuid4().hex}"
    ship(spark)

    def parts(batches):
        import pyarrow as pa

        found, out = [], None
        with ExitStack() as stack:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    for row in batch.slice(start, 256).to_pylist():
                        if not found or found[-1]["log_id"] != row["log_id"]:
                            stack.close()
                            found.append({"task": TaskContext.get().partitionId(), "n": len(found), "log_id": row["log_id"], "part": uuid.uuid4().hex})
                            out = stack.enter_context(text_output(f"{aside}/{found[-1]['part']}", compress))
                        write(out, row)
        yield pa.RecordBatch.from_pylist(found, pa.schema([("task", pa.int32()), ("n", pa.int32()), ("log_id", pa.string()), ("part", pa.string())]))

    def together(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_output(row["path"]) as out:
                    for part in row["parts"]:
                        system, place = file_system(f"{aside}/{part}")
                        with system.open_input_stream(place, compression=None) as stream:
                            shutil.copyfileobj(stream, out, 1 << 20)
            yield batch.select(["n"])

    try:
        by_log: dict[str, list[str]] = {}
        with shuffles_deleted(spark):
            found = rows.mapInArrow(parts, "task int, n int, log_id string, part string").collect()  # a row per task and log
        for r in sorted(found):
            by_log.setdefault(r.log_id, []).append(r.part)
        paths = [f"{folder.rstrip('/')}/{quote_path(log_id, safe='')}{suffix}" for log_id in by_log]
        if paths:
            documents = spark.createDataFrame([(n, p, own) for n, (p, own) in enumerate(zip(paths, by_log.values(), strict=True))], "n int, path string, parts array<string>")
            documents.repartitionByRange(min(len(paths), 1000), "n").mapInArrow(together, "n int").collect()
    finally:
        system, place = file_system(aside)
        if system.get_file_info(place).type.name == "Directory":
            system.delete_dir(place)
    return paths


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Shuffle files of queries that are built and run inside go when these end, not when the driver's memory is next cleaned."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Unclosed(io.RawIOBase):
    """A stream that another one writes through without closing it."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)


def to_zip(result: PqlResult, path: str, log_name: str = "log") -> None:
    """Write a zip archive with the single entry ``xes.xml``."""
    with open_output(path) as raw, zipfile.ZipFile(Unclosed(raw), "w", zipfile.ZIP_DEFLATED) as archive, archive.open("xes.xml", "w") as entry, io.TextIOWrapper(entry, "utf-8", newline="\n") as out:
        write_xes(result, out, log_name)
