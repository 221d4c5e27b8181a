"""XES reading and writing, the catalog, deletion."""

import gzip
import io
import json
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from hierql.compare import Match, compare
from hierql.engine import DEFAULT_LIMITS, execute
from hierql.functions.catalog import Scope
from hierql.operators.delete import delete
from hierql.sources.samples import load_sample, samples
from hierql.sources.xes_json import to_json
from hierql.sources.xes_reader import Document, XesError, read_rows, read_xes, typed
from hierql.sources.xes_writer import to_xes, to_zip, write_xes
from hierql.store import Catalog

DOCUMENT = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0" xes.features="nested-attributes" xmlns="http://www.xes-standard.org/">
  <extension name="Concept" prefix="con" uri="http://www.xes-standard.org/concept.xesext"/>
  <extension name="Time" prefix="time" uri="http://www.xes-standard.org/time.xesext"/>
  <global scope="trace"><string key="con:name" value="?"/></global>
  <global><string key="con:name" value="none"/></global>
  <classifier name="Activity" keys="concept:name"/>
  <string key="con:name" value="Sample"/>
  <string key="source" value="hand"><int key="year" value="2024"><string key="by" value="me"/></int><string key="it's" value="q"/></string>
  <list key="tags"><values><string key="a" value="x"/><string key="a" value="y"/></values></list>
  <trace>
    <string key="con:name" value="C1"/><int key="priority" value="3"/>
    <event><string key="con:name" value="Register"/><date key="time:timestamp" value="2024-01-01T10:00:00+01:00"/><float key="cost:total" value="50"/><boolean key="ok" value="true"/></event>
    <event><string key="con:name" value="Check"/><date key="time:timestamp" value="2024-01-01T11:00:00.500+01:00"/><float key="cost:total" value="75.5"/></event>
  </trace>
  <trace><string key="con:name" value="C2"/><string value="no key"/><string key="" value="empty key"/>
    <event><string key="con:name" value="Register"/><int key="weight" value="heavy"/></event>
    <event/>
  </trace>
</log>
"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    file = tmp_path_factory.mktemp("xes") / "sample.xes"
    file.write_text(DOCUMENT)
    return str(file)


@pytest.fixture(scope="module")
def store(spark, path, tmp_path_factory):
    return read_xes(spark, path, str(tmp_path_factory.mktemp("rows") / "rows"))


def parse(text):
    return list(Document(io.BytesIO(text.encode())).rows())


def test_levels_types_and_prefixes(store):
    assert [tuple(r) for r in store.logs.select("log_id", "concept_name", "xes_version").collect()] == [("sample", "Sample", "1.0")]
    events = store.events.orderBy("trace_id", "event_order").collect()
    assert [e.concept_name for e in events] == ["Register", "Check", "Register", None]
    assert events[0].time_timestamp.replace(tzinfo=UTC) == datetime(2024, 1, 1, 9, tzinfo=UTC)
    assert events[0].attrs["ok"].b is True and events[2].attrs["weight"].s == "heavy"
    assert store.traces.orderBy("trace_order").collect()[1].attrs[""].s == "empty key"
    assert store.header["globals"][1]["scope"] == "event"


def test_gzip_is_found_by_content(spark, tmp_path):
    file = tmp_path / "plain-name.xes"
    file.write_bytes(gzip.compress(DOCUMENT.encode()))
    assert read_xes(spark, str(file)).events.count() == 4


@pytest.mark.parametrize(
    "body",
    ["<trace><trace/></trace>", "<event/>", '<global scope="log"/>', '<classifier name="x" keys="y" scope="log"/>', '<string key="a" value="b"><values/></string>', '<wrong key="a" value="b"/>', "<trace>"],
)
def test_illegal_documents(body):
    with pytest.raises(XesError):
        parse(f"<log>{body}</log>")


def test_values_that_do_not_parse_stay_text():
    assert typed("int", "x")["t"] == "string" and typed("date", "soon")["s"] == "soon" and typed("id", "1")["s"] == "1"
    assert typed("id", "8F2A8F2A-0000-1111-2222-333344445555")["s"] == "8f2a8f2a-0000-1111-2222-333344445555"


def test_custom_and_nested_attributes_in_queries(store):
    r = execute(store, "select t:name where [t:priority] > 2")
    assert [x.t_concept_name for x in r.traces.collect()] == ["C1"]
    r = execute(store, "select l:name where [l:\x1fssource\x1fyear] = 2024")
    assert r.logs.count() == 1
    assert execute(store, "where [l:\x1fssource\x1fit's] = 'q' and not [l:\x1fssource\x1fnone] is not null").logs.count() == 1
    r = execute(store, "select count(e:name) group by c:Activity")
    assert r.events.count() == 3


def test_round_trip(spark, store, tmp_path):
    for compress in (False, True):
        out = tmp_path / f"again-{compress}.xes"
        to_xes(execute(store, ""), str(out), compress)
        again = read_xes(spark, str(out))
        for scope in Scope:
            columns = [c for c in store.levels[scope].columns if not c.endswith("_id") or c == "identity_id"]
            rows = lambda s: sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in s.levels[scope].select(*columns).collect())  # noqa: B023, E731
            assert rows(again) == rows(store)
        assert again.header == store.header | {"extensions": again.header["extensions"]}


def test_extension_prefixes_and_empty_events_are_written(store):
    out = io.StringIO()
    write_xes(execute(store, "select l:name, t:name"), out)
    text = out.getvalue()
    assert '<string key="con:name" value="Sample"/>' in text and text.count("<event/>") == 4
    out = io.StringIO()
    write_xes(execute(store, "where 0=1"), out, "nothing")
    assert '<string key="con:name" value="nothing"/>' in out.getvalue() and 'prefix="con"' in out.getvalue()


def test_documents_of_one_name_stay_apart(spark, tmp_path):
    other = DOCUMENT.replace('prefix="con"', 'prefix="concept"').replace("con:name", "concept:name").replace('keys="concept:name"', 'keys="time:timestamp"').replace('name="Activity"', 'name="When"')
    for folder, text in (("a", DOCUMENT), ("b", other)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "log.xes").write_text(text)
    paths = [str(tmp_path / "b" / "log.xes"), str(tmp_path / "a" / "log.xes")]
    for whole_bytes in (1 << 20, 0):  # read as values, and streamed
        rows = read_rows(spark, paths, whole_bytes).where("level = 2").select("log_id", "log_order").collect()
        assert sorted(map(tuple, rows)) == [("a/log", 1)] * 4 + [("b/log", 0)] * 4
    both = read_xes(spark, paths)
    assert execute(both, "select l:name, t:name, e:name").flat().count() == 8
    out = io.StringIO()
    write_xes(execute(both, "select *"), out)
    first, second = out.getvalue().split("</log>")[:2]
    assert 'prefix="concept"' in first and 'name="When"' in first and "con:name" not in first
    assert 'prefix="con"' in second and 'name="Activity"' in second and 'name="When"' not in second
    (tmp_path / "b" / "log.xes.gz").write_bytes(gzip.compress(other.encode()))
    with pytest.raises(XesError):
        read_xes(spark, [*paths, str(tmp_path / "b" / "log.xes.gz")])


def test_one_trace_is_held_at_a_time():
    trace = '<trace><string key="a" value="b"/>' + '<event><string key="a" value="b"/></event>' * 20 + "</trace>"
    import tracemalloc

    def peak(n):
        data = io.BytesIO(f"<log>{trace * n}</log>".encode())
        tracemalloc.start()
        count = sum(1 for _ in Document(data).rows())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == 21 * n + 1
        return most

    assert peak(2_000) < peak(20) + 1_000_000


def test_comparison_of_results(store):
    whole = list(to_json(execute(store, "")))
    assert compare(whole, list(to_json(execute(store, "")))).match is Match.EQUAL
    turned = list(to_json(execute(store, "select * order by t:name desc, e:name desc")))
    assert compare(whole, turned).match is Match.DIFFERENT and not compare(whole, turned) and compare(whole, turned).differences
    assert compare(whole, turned, order_is_open=True).match is Match.REORDERED
    fewer = list(to_json(execute(store, "limit t:1")))
    assert compare(whole, fewer, window_is_open=True).match is Match.CUT_AMONG_EQUALS and compare(fewer, whole, window_is_open=True)
    assert compare(whole, fewer).differences == ["log 1: 2 and 1 traces"]
    a, b = ([{"log": {"float": {"@key": "x", "@value": v}, "id": {"@key": "i", "@value": v}, "trace": t}}] for v, t in (("0.1", {"event": None}), ("0.10000000000001", [{"event": []}])))
    assert compare(a, b).match is Match.EQUAL
    assert compare(a, [{"log": {"string": {"@key": "x", "@value": "0.1"}}}]).match is Match.DIFFERENT


def test_samples(spark):
    assert {s["name"] for s in samples()} >= {"small", "long"} and all(s["description"] for s in samples())
    assert load_sample(spark, "small").events.count() == 1_000
    with pytest.raises(KeyError):
        load_sample(spark, "none")


def test_results_do_not_depend_on_the_time_zone(spark, store):
    query = "select hour(e:timestamp), date(e:timestamp) where e:timestamp >= D2024-01-01T09:30"
    before = [tuple(r) for r in execute(store, query).events.select("fn_0", F.col("fn_1").cast("string")).collect()]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        found = execute(store, query).events
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
        assert [tuple(r) for r in found.select("fn_0", F.col("fn_1").cast("string")).collect()] == before and len(before) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_fan_out_ignores_the_cap_on_logs(spark, tmp_path):
    for n in range(12):
        (tmp_path / f"l{n:02}.xes").write_text(DOCUMENT)
    many = read_xes(spark, str(tmp_path))
    assert execute(many, "select l:name", limits=DEFAULT_LIMITS).logs.count() == 10
    assert execute(many, "select l:name, t:name, c:Activity", limits=DEFAULT_LIMITS).logs.count() == 10
    assert execute(many, "select l:name, t:name, c:Activity", limits=DEFAULT_LIMITS, fan_out=True).logs.count() == 12
    assert execute(many, "limit l:3", limits=DEFAULT_LIMITS, fan_out=True).logs.count() == 3


def test_zip(store, tmp_path):
    to_zip(execute(store, "limit e:1"), str(tmp_path / "x.zip"))
    with zipfile.ZipFile(tmp_path / "x.zip") as archive:
        assert archive.namelist() == ["xes.xml"] and archive.read("xes.xml").count(b"<event>") == 2


def test_json(store):
    (log,) = [d["log"] for d in to_json(execute(store, ""))]
    assert log["string"][0] == {"@key": "concept:name", "@value": "Sample"}
    first, second = log["trace"]
    assert first["int"] == {"@key": "priority", "@value": "3"}
    assert first["event"][1]["date"] == {"@key": "time:timestamp", "@value": "2024-01-01T10:00:00.500Z"}
    assert second["event"][1] is None and log["id"]["@key"] == "identity:id" and len(log["global"]) == 2
    (log,) = [d["log"] for d in to_json(execute(store, "select count(^^e:name), l:name group by l:name"))]
    assert log["int"] == {"@key": "count(^^event:concept:name)", "@value": "3"}
    (log,) = [d["log"] for d in to_json(execute(store, ""), events=False)]
    assert "event" not in log["trace"][0]


def test_delete(store):
    rest, counts = delete(store, "delete trace where t:name = 'C1'")
    assert counts == {Scope.TRACE: 1, Scope.EVENT: 2} and rest.events.count() == 2 and rest.logs.count() == 1
    rest, counts = delete(store, "delete where e:name is null")
    assert counts == {Scope.EVENT: 1} and rest.traces.count() == 2
    rest, counts = delete(store, "delete log")
    assert counts == {Scope.LOG: 1, Scope.TRACE: 2, Scope.EVENT: 4}
    with pytest.raises(ValueError):
        delete(store, "limit l:1")
    with pytest.raises(ValueError):
        execute(store, "delete event")


def test_catalog(spark, path, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    a, b = catalog.create("one")["id"], catalog.create("two")["id"]
    log = catalog.import_xes(a, path, "first")
    other = catalog.import_xes(b, path)
    with pytest.raises(ValueError):
        catalog.import_xes(a, path, "first")
    with pytest.raises(KeyError):
        catalog.import_xes("none", path)
    assert catalog.rename(a, "uno")["name"] == "uno" and [s["name"] for s in catalog.list()] == ["uno", "two"]
    assert [tuple(r) for r in catalog.statistics().orderBy("events").select("traces", "events").collect()] == [(2, 4), (2, 4)]
    assert catalog.query("select e:name", store=a).events.count() == 4
    assert catalog.query("select count(^t:name)", log_id=log, store=b).logs.first().fn_0 == 2
    assert catalog.delete("delete event where e:name = 'Check'", store=a) == 1
    assert catalog.query("select e:name", log_id=log).events.count() == 3 and catalog.query("select e:name", log_id=other).events.count() == 4
    catalog.update_log(log, {"kind": "test"})
    assert catalog.search(attribute=("kind", "test")) == [log] and catalog.search(name="sam") == sorted([log, other])
    assert catalog.search(created_from=datetime(2000, 1, 1, tzinfo=UTC)) == sorted([log, other])
    assert catalog.log_summaries(b).first().name == "Sample"
    catalog.delete_log(other)
    assert catalog.get(b)["logs"] == []
    catalog.remove(a)
    assert catalog.search() == []
