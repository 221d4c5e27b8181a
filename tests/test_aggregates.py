"""Exact values of aggregates under hoisting, filtering and grouping."""

import pytest
from fixtures import hoist_logs, make_store

from hierql.engine import execute

HIT, HOIST = "[e:attr_1]='hit'", "[^e:attr_1]='hit'"


@pytest.fixture(scope="module")
def store(spark):
    return make_store(spark, hoist_logs())


def rows(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("log_id", "_pos").collect()]


@pytest.mark.parametrize(("where", "empty"), [(HOIST, 2), (HIT, 1), ("t:name='T0'", 2)])
def test_log_counts_read_whole_log(store, where, empty):
    r = execute(store, f"select count(^t:name), count(^^e:name) where {where} limit l:1, t:1", log_id="A")
    assert rows(r.logs, "fn_0", "fn_1") == [(3, 6)]
    assert rows(r.placeholders(), "_null_event_count") == [(empty,)]


def test_one_log_across_sources(store):
    r = execute(store, f"select count(l:name), count(^t:name), count(^^e:name), sum(^^e:total), min(^^e:total), max(^^e:total), avg(^^e:total) where {HOIST} limit l:1, t:1")
    assert rows(r.logs, *[f"fn_{i}" for i in range(7)]) == [(2, 5, 10, 55.0, 1.0, 10.0, 5.5)]


def test_log_filter_restricts_population(store):
    r = execute(store, f"select count(^t:name), sum(^^e:total) where l:name='A' and {HOIST} limit l:1,t:1")
    assert rows(r.logs, "fn_0", "fn_1") == [(3, 21.0)]


@pytest.mark.parametrize("where", [HIT, HOIST])
def test_trace_counts_per_log(store, where):
    r = execute(store, f"select count(t:name) where {where} limit l:10,t:1")
    assert rows(r.traces, "fn_0") == [(2,), (1,)]


def test_hoisted_event_aggregates_read_whole_traces(store):
    r = execute(store, f"select sum(^e:total), avg(^e:total), min(^e:total), max(^e:total) where {HIT} limit l:10,t:1")
    assert rows(r.traces, "fn_0", "fn_1", "fn_2", "fn_3") == [(14.0, 3.5, 1.0, 6.0), (15.0, 7.5, 7.0, 8.0)]


def test_explicit_trace_groups(store):
    r = execute(store, f"select t:name, count(^e:name), sum(^e:total) where {HIT} group by t:name order by t:name limit l:10,t:10")
    assert rows(r.traces, "log_id", "t_concept_name", "fn_1", "fn_2") == [("A", "T0", 2, 3.0), ("A", "T2", 2, 11.0), ("B", "T0", 2, 15.0)]


def test_explicit_log_groups_and_order(store):
    r = execute(store, f"select l:name, count(^t:name), sum(^^e:total) where {HIT} group by l:name order by l:name limit l:10,t:1")
    assert [tuple(x) for x in r.logs.orderBy("_pos").select("l_concept_name", "fn_1", "fn_2").collect()] == [("A", 3, 21.0), ("B", 2, 34.0)]
    r = execute(store, f"select l:name, sum(^^e:total) where {HIT} group by l:name order by sum(^^e:total) desc limit l:1,t:1")
    assert rows(r.logs, "l_concept_name", "fn_1") == [("A", 21.0)]


def test_event_aggregates_read_matching_events(store):
    r = execute(store, f"select count(e:name), sum(e:total) where {HIT} limit l:10,t:10,e:10")
    assert sorted(rows(r.events, "log_id", "fn_0", "fn_1")) == [("A", 1, 1.0), ("A", 2, 11.0), ("B", 1, 7.0)]


def test_order_by_hoisted_aggregate(store):
    r = execute(store, f"select t:name, sum(^e:total) where {HIT} group by t:name order by sum(^e:total) desc limit l:1,t:1", log_id="A")
    assert rows(r.traces, "t_concept_name", "fn_1") == [("T2", 11.0)]


def test_nothing_matches(store):
    r = execute(store, "select count(^t:name), count(^^e:name) where [e:attr_1]='missing'")
    assert r.logs.count() == r.traces.count() == r.events.count() == 0


def test_every_scope_at_once(store):
    r = execute(store, f"select count(l:name), count(^t:name), count(^^e:name), count(t:name), count(^e:name), count(e:name) where {HIT}")
    assert rows(r.logs, "fn_0", "fn_1", "fn_2") == [(2, 5, 10)]
    assert rows(r.traces, "fn_3", "fn_4") == [(3, 6)]
    assert rows(r.events, "fn_5") == [(4,)]


def test_variants_of_filtered_events(store):
    r = execute(store, f"select count(^e:name) where {HIT} group by ^e:name", log_id="A")
    assert rows(r.placeholders(), "fn_0", "_null_event_count") == [(2, 1), (2, 2)]


def test_trace_without_events_counts(spark):
    store = make_store(spark, [("A", [("T0", [{"name": "E0"}]), ("EmptyTrace", [])])])
    r = execute(store, "select count(t:name) where t:name='EmptyTrace'")
    assert rows(r.placeholders(), "fn_0", "_null_event_count") == [(1, 0)]
    assert r.events.count() == 0


def test_prefix_sets_the_scope(store):
    r = execute(store, "select t:min(l:name) limit l:3")
    assert rows(r.traces, "fn_0") == [("A",), ("B",)]


def test_event_groups_and_hoisted_aggregate_together(store):
    r = execute(store, "select l:name, t:name, max(^e:total)-min(^e:total), e:name, count(e:name) group by t:name, e:name", log_id="A")
    assert rows(r.traces, "t_concept_name", "col_2") == [("T0", 1.0), ("T1", 1.0), ("T2", 1.0)]
    assert len(rows(r.events, "e_concept_name", "fn_4")) == 6


def test_log_group_by_sequence_with_event_sum(store):
    r = execute(store, "select sum(e:total) group by ^^e:name")
    assert sum(x[0] for x in rows(r.events, "fn_0")) == 55.0
