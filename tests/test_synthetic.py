"""The declared workload on synthetic logs, with its declared results."""

from datetime import datetime

import pytest

from hierql.engine import execute
from hierql.sources.synthetic import synthetic


@pytest.mark.parametrize("length", [10, 1000])
def test_global_event_aggregation(spark, length):
    r = execute(synthetic(spark, 100_000 // length, length), "select count(^^e:name), min(^^e:timestamp), max(^^e:timestamp) limit l:1, t:1").logs.first()
    assert (r.fn_0, r.fn_1, r.fn_2) == (100_000, datetime(2020, 1, 1), datetime(2020, 3, 10, 10, 39))


@pytest.mark.parametrize(("percent", "expected"), [(1, 100), (10, 1_000), (100, 10_000)])
def test_selectivity(spark, percent, expected):
    store = synthetic(spark, 10_000, matching_percent=percent)
    for reference in ("[e:attr_1]", "[^e:attr_1]"):
        assert execute(store, f"select count(t:name) where {reference} = 'hit' limit l:1, t:1").traces.first().fn_0 == expected


@pytest.mark.parametrize("variants", [1, 100])
def test_variants(spark, variants):
    r = execute(synthetic(spark, 1_000, variants=variants), "select count(t:name) group by ^e:name")
    assert r.traces.count() == variants and r.traces.agg({"fn_0": "sum"}).first()[0] == 1_000


def test_windows(spark):
    store = synthetic(spark, 100, 20)
    assert execute(store, "limit l:1, t:30, e:20").events.count() == 600
    assert execute(store, "where ^e:name = 'activity-10' limit l:1, t:10, e:20").events.count() == 200
    assert execute(store, "where e:name like '%zzq%'").logs.count() == 0
    r = execute(store, "select min(e:timestamp), max(e:timestamp), sum(e:total) limit l:1, t:2").events.orderBy("trace_id").collect()
    assert [(x.fn_0, x.fn_2) for x in r] == [(datetime(2020, 1, 1), 262.5), (datetime(2020, 1, 1, 0, 20), 262.5)]
