"""Filters, expressions, ordering and windows on small logs, and random cross-checks."""

import itertools
import random

import pytest
from fixtures import hoist_logs, make_store, multi_logs

from hierql.engine import execute
from hierql.functions.catalog import Scope
from hierql.operators.expressions import like
from hierql.plans.compiler import Classifier


@pytest.fixture(scope="module")
def store(spark):
    return make_store(spark, hoist_logs())


@pytest.fixture(scope="module")
def multi(spark):
    return make_store(spark, multi_logs(), [Classifier("Activity", ("concept:name",))])


def ids(frame, column):
    return sorted(r[column] for r in frame.select(column).collect())


def test_event_filter_drops_childless_parents(store):
    r = execute(store, "where e:total > 7.5")
    assert ids(r.logs, "log_id") == ["B"] and ids(r.traces, "trace_id") == ["B-0", "B-1"] and ids(r.events, "event_id") == ["B-0-1", "B-1-0", "B-1-1"]


def test_trace_filter_keeps_all_events_and_empty_traces(spark):
    store = make_store(spark, [("A", [("T0", [{"name": "x"}, {"name": "y"}], {"total": 5.0}), ("T1", [], {"total": 6.0})])])
    r = execute(store, "where t:total > 4")
    assert r.traces.count() == 2 and r.events.count() == 2


def test_log_without_traces_stays_without_child_conditions(spark):
    store = make_store(spark, [("A", [("T0", [{"name": "x"}])]), ("Empty", [])])
    assert execute(store, "limit l:5").logs.count() == 2
    assert execute(store, "where t:name is not null").logs.count() == 1


def test_hoisted_conditions_share_one_event(spark):
    events = [{"name": "a", "total": 1.0}, {"name": "b", "total": 2.0}]
    store = make_store(spark, [("A", [("T0", events)])])
    assert execute(store, "where ^e:name = 'a' and ^e:total = 1").traces.count() == 1
    assert execute(store, "where ^e:name = 'a' and ^e:total = 2").traces.count() == 0
    assert execute(store, "where e:name = 'b' and ^e:name = 'a'").events.count() == 1
    assert execute(store, "where not(^e:name = 'a')").traces.count() == 1
    assert execute(store, "where ^e:name = 'a' and ^^e:name = 'b'").traces.count() == 0


def test_multi_log_order_and_ranking(multi):
    assert [r.log_id for r in execute(multi, "limit l:1").logs.collect()] == ["Alpha"]
    assert [r.log_id for r in execute(multi, "order by e:timestamp, e:name limit l:1").logs.collect()] == ["Beta"]
    r = execute(multi, "where e:name like '%rejection'")
    assert ids(r.logs, "log_id") == ["Beta"]


def test_variants_stay_within_their_log(multi):
    r = execute(multi, "select count(t:name), count(^e:name) group by ^e:name order by count(t:name) desc limit l:1,t:3")
    assert [(x.fn_0, x.fn_1) for x in r.traces.orderBy("_pos").collect()] == [(1, 2), (1, 1)]
    assert execute(multi, "group by ^c:Activity").traces.count() == 3


def test_unnamed_traces_group_but_do_not_count(spark):
    store = make_store(spark, [("A", [(None, [{"name": "x"}]), (None, [{"name": "x"}]), ("T", [{"name": "y"}])])])
    r = execute(store, "select count(t:name) group by ^e:name order by count(t:name)")
    assert [(x.fn_0, x._trace_count) for x in r.traces.orderBy("_pos").collect()] == [(0, 2), (1, 1)]


def test_nulls_stay_in_sequences(spark):
    store = make_store(spark, [("A", [("T0", [{"name": "x"}, {"name": None}]), ("T1", [{"name": "x"}]), ("T2", [{"name": None}, {"name": "x"}])])])
    assert execute(store, "select count(t:name) group by ^e:name").traces.count() == 3
    assert execute(store, "select count(t:name) group by ^e:name order by e:name").traces.count() == 2


def test_windows_keep_parents(store):
    r = execute(store, "offset e:100")
    assert r.traces.count() == 5 and r.events.count() == 0
    r = execute(store, "limit l:1, t:2, e:1 offset t:1")
    assert ids(r.traces, "trace_id") == ["A-1", "A-2"] and ids(r.events, "event_id") == ["A-1-0", "A-2-0"]


def test_default_caps_lower_only(store):
    assert execute(store, "limit t:2", limits={Scope.TRACE: 1, Scope.EVENT: 1}).traces.count() == 2
    assert execute(store, "limit t:1", limits={Scope.TRACE: 2}).traces.count() == 2


def test_null_order(spark):
    store = make_store(spark, [("A", [("T0", [{"name": "n"}, {"name": "b", "total": 2.0}, {"name": "a", "total": 1.0}])])])
    names = lambda q: [r.e_concept_name for r in execute(store, q).events.orderBy("_pos").collect()]
    assert names("select e:name order by e:total") == ["a", "b", "n"] and names("select e:name order by e:total desc") == ["n", "b", "a"]


def test_column_names_and_nesting(multi):
    r = execute(multi, "select l:name, count(^e:name), e:name group by ^e:name")
    assert r.names(Scope.TRACE) == {"fn_1": "count(^event:concept:name)"}
    row = r.nested().where("log_id = 'Alpha'").first()
    assert [[e.e_concept_name for e in t.events] for t in row.traces] == [["Shared intake", "Alpha approval"], ["Alpha archive"]]
    assert r.flat().count() == 5


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("a%", ["a", "abc"], ["ba"]), ("%a", ["a", "ba"], ["ab"]), ("%a%", ["xay"], ["x"]), ("a_c", ["abc", "a\nc"], ["ac"]), (r"50\%", ["50%"], ["50x"]), (r"a\_b", ["a_b"], ["axb"]), (r"a\b", [r"a\b"], ["ab"]), ("%", ["", "x"], []), ("a.c%", ["a.cd"], ["abcd"]), ("", [""], ["x"]), ("_%", ["x"], [""])],
)
def test_like(spark, pattern, yes, no):
    from pyspark.sql import functions as F

    got = {r.v: r.ok for r in spark.createDataFrame([(v,) for v in [*yes, *no, None]], "v string").select("v", like(F.col("v"), pattern).alias("ok")).collect()}
    assert all(got[v] is True for v in yes) and all(got[v] is False for v in no) and got[None] is None


def test_scalar_functions(spark):
    store = make_store(spark, [("A", [("T0", [{"name": "Ab", "total": -1.5, "ts": 3661.25}])])])
    r = execute(store, "select hour(e:timestamp), minute(e:timestamp), second(e:timestamp), millisecond(e:timestamp), dayofweek(e:timestamp), quarter(e:timestamp), round(e:total), upper(e:name), lower(e:name), date(e:timestamp), time(e:timestamp), e:total / 0, e:name + '!'").events.first()
    assert [r[f"fn_{i}"] for i in range(9)] == [1.0, 1.0, 1.0, 250.0, 2.0, 1.0, -1.0, "AB", "ab"]
    assert str(r.fn_9) == "2024-01-01" and r.fn_10 == "01:01:01.250" and r.col_11 is None and r.col_12 == "Ab!"


# -- random cross-checks against a plain evaluation -----------------------------------------


def random_logs(seed):
    rnd = random.Random(seed)
    return [(f"L{i}", [(rnd.choice(["T", "U", None]), [{"name": rnd.choice(["a", "b", None]), "total": float(rnd.randint(0, 3))} for _ in range(rnd.randint(0, 4))]) for _ in range(rnd.randint(1, 5))]) for i in range(2)]


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    logs = random_logs(seed)
    store = make_store(spark, logs)
    r = execute(store, "select count(^t:name), sum(^^e:total) where ^e:name = 'a' and not(^e:total = 0) group by l:name")
    expected = []
    for _, traces in logs:
        if any(e["name"] == "a" and e["total"] != 0 for _, es in traces for e in es):
            totals = [e["total"] for _, es in traces for e in es]
            expected.append((sum(t is not None for t, _ in traces), sum(totals)))
    assert sorted((x.fn_0, x.fn_1) for x in r.logs.collect()) == sorted(expected)
    r = execute(store, "select count(t:name), avg(^e:total) where e:total < 3 group by ^e:name")
    groups: dict = {}
    for i, (_, traces) in enumerate(logs):
        for t, es in traces:
            kept = tuple(e["name"] for e in es if e["total"] < 3)
            if kept:
                groups.setdefault((i, kept), []).append((t, [e["total"] for e in es]))
    expected = [(sum(t is not None for t, _ in g), round(sum(itertools.chain(*(v for _, v in g))) / sum(len(v) for _, v in g), 6)) for g in groups.values()]
    assert sorted((x.fn_0, round(x.fn_1, 6)) for x in r.traces.collect()) == sorted(expected)
    r = execute(store, "select e:name, count(e:total) group by e:name limit e:1")
    expected = []
    for _, traces in logs:
        for _, es in traces:
            if es:
                expected.append((es[0]["name"] or "", sum(e["name"] == es[0]["name"] for e in es)))
    assert sorted((x.e_concept_name or "", x.fn_1) for x in r.events.collect()) == sorted(expected)
