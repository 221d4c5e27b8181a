"""Documents that executors write: the text that the driver's stream gives, none of which reaches the driver."""

import gzip
import io
import json
from pathlib import Path
from urllib.parse import unquote

import pytest
from fixtures import make_store, multi_logs
from pyspark.sql.classic.dataframe import DataFrame
from test_xes import DOCUMENT

from hierql.engine import execute
from hierql.sources.rendering import logs
from hierql.sources.xes_json import to_json, to_json_each
from hierql.sources.xes_reader import read_xes
from hierql.sources.xes_writer import DECLARATION, to_xes_each, write_log
from hierql.store import Catalog


@pytest.fixture
def cut(spark):
    """Many small partitions, which end inside of traces."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def received(monkeypatch):
    """Lengths of the rows that reach the driver."""
    lengths = []
    collect, stream = DataFrame.collect, DataFrame.toLocalIterator

    def collected(self):
        rows = collect(self)
        lengths.extend(len(str(r)) for r in rows)
        return rows

    def streamed(self, *args, **kwargs):
        for r in stream(self, *args, **kwargs):
            lengths.append(len(str(r)))
            yield r

    monkeypatch.setattr(DataFrame, "collect", collected)
    monkeypatch.setattr(DataFrame, "toLocalIterator", streamed)
    return lengths


def by_driver(result):
    out = {}
    for log in logs(result):
        text = io.StringIO()
        text.write(DECLARATION)
        write_log(result, log, text, "log")
        out[log.log_id] = text.getvalue()
    return out


def by_executors(result, folder, compress):
    out = {}
    for path in to_xes_each(result, str(folder), compress):
        data = Path(path).read_bytes()
        out[unquote(Path(path).name.partition(".xes")[0])] = (gzip.decompress(data) if compress else data).decode()
    assert len(list(Path(folder).glob("*"))) == len(out)  # parts go
    return out


def long_logs():
    """A long trace, traces without events, a log without traces, names that paths and XML escape."""
    events = [{"name": f"E<{i}>\n", "ts": i, "total": i / 4, "attr": None if i % 3 else "é&"} for i in range(200)]
    return [("Z/1 ä", [("one", events), ("two", []), ("three", events[:1], {"total": 2.5})]), ("none", []), *multi_logs()]


QUERIES = ["", "select t:name", "select l:name, t:name, e:name order by e:name desc, t:name limit l:3, e:150", "select count(t:name), e:name group by ^e:name", "select count(t:name) group by ^e:name", "select e:name, count(e:name) group by e:name", "where 0=1"]


@pytest.mark.parametrize("query", QUERIES)
def test_executors_write_what_the_driver_would(spark, cut, tmp_path, query):
    result = execute(make_store(spark, long_logs()), query)
    want = by_driver(result)
    assert by_executors(result, tmp_path / "d", len(query) % 2 == 0) == want and list(want) == [unquote(Path(p).name.removesuffix(".xes")) for p in to_xes_each(result, str(tmp_path / "again"))]


def test_headers_prefixes_and_custom_attributes(spark, cut, tmp_path):
    for name, text in (("a", DOCUMENT), ("b", DOCUMENT.replace('prefix="con"', 'prefix="concept"').replace("con:name", "concept:name"))):
        (tmp_path / f"{name}.xes").write_text(text)
    result = execute(read_xes(spark, [str(tmp_path / "a.xes"), str(tmp_path / "b.xes")]), "")
    found = by_executors(result, tmp_path / "d", True)
    assert found == by_driver(result) and 'key="con:name"' in found["a"] and 'key="con:name"' not in found["b"]


def test_no_text_reaches_the_driver(spark, tmp_path, received):
    events = [{"name": "x" * 1_000, "ts": i} for i in range(300)]
    result = execute(make_store(spark, [("A", [("one", events)]), ("B", [("one", events)])]), "")
    for write in (to_xes_each, to_json_each):
        assert [Path(p).stat().st_size > 300_000 for p in write(result, str(tmp_path / write.__name__))] == [True, True]
    assert sum(received) < 10_000


def test_a_catalog_imports_and_deletes_without_rows_on_the_driver(spark, tmp_path, received):
    events = [{"name": "keep" if i % 3 else "drop", "ts": i, "attr": "y" * 1_000} for i in range(300)]
    (path,) = to_xes_each(execute(make_store(spark, [("A", [("one", events), ("two", [])])]), ""), str(tmp_path / "d"), True)
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    log = catalog.import_xes(catalog.create("s")["id"], path)
    assert catalog.delete("delete event where e:name = 'drop'", log_id=log) == 100
    assert sum(received) < 10_000
    rest = catalog.query("select e:name, [e:attr_1]", log_id=log)
    assert rest.events.where("e_concept_name = 'keep' and length(e_attr_1) = 1000").count() == 200 and rest.traces.count() == 2


@pytest.mark.parametrize("query", QUERIES)
def test_executors_write_the_same_json(spark, cut, tmp_path, query):
    result = execute(make_store(spark, long_logs()), query)
    want = [json.dumps(document) + "\n" for document in to_json(result)]
    assert [Path(p).read_text() for p in to_json_each(result, str(tmp_path / "d"))] == want
