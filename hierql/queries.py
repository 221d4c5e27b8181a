"""Registered queries over the driver's tables, each with SQL for the same rows.

A query is a text of the query language over one of the adapters, and the
columns to return.  Positions and ids are returned as they are; floating
results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hierql.engine import DEFAULT_LIMITS, execute
from hierql.functions.catalog import Scope
from hierql.model import IDS
from hierql.operators.delete import without
from hierql.sources import adapters
from hierql.sources.files import shared_file
from hierql.sources.xes_json import to_json_each
from hierql.sources.xes_reader import read_xes
from hierql.sources.xes_writer import to_xes_each
from hierql.store import Catalog

STORES = {"clicks": adapters.clickstream, "orders": adapters.orders, "talks": adapters.dialogues, "texts": adapters.texts}


@dataclass
class Registered:
    store: str
    text: str
    level: str  # logs, traces, placeholders, events or flat
    columns: dict[str, str]  # output name -> expression over the level
    sql: str | None = None
    log_id: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        result = execute(STORES[self.store](spark, sf_dir), self.text, log_id=self.log_id)
        frame = result.flat() if self.level == "flat" else result.placeholders() if self.level == "placeholders" else getattr(result, self.level)
        return frame.select(*[F.expr(e).alias(n) for n, e in self.columns.items()])


#: The three levels of each adapter, as SQL views of their own.
ORDERS_SQL = """WITH l AS (SELECT DISTINCT c_mktsegment AS log_id FROM customer),
t AS (SELECT c_mktsegment AS log_id, o_orderkey AS tid, CAST(o_orderkey AS VARCHAR) AS trace_id, o_totalprice AS total, o_orderpriority, o_orderstatus, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT t.log_id, t.tid, t.trace_id, (l_linenumber, l_partkey, l_suppkey, l_shipdate) AS n, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS event_id, l_returnflag || l_linestatus AS name, l_shipdate AS ts, l_extendedprice AS total, CAST(l_suppkey AS VARCHAR) AS resource, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem JOIN t ON l_orderkey = t.tid)
"""
CLICKS_SQL = """WITH t AS (SELECT DISTINCT 'events' AS log_id, user_id AS tid, CAST(user_id AS VARCHAR) AS trace_id FROM events),
e AS (SELECT 'events' AS log_id, user_id AS tid, CAST(user_id AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS event_id, event_id AS n, ts, event_type AS name, value AS total, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
"""
TALKS_SQL = """WITH t AS (SELECT DISTINCT conv_id AS tid, CAST(conv_id AS VARCHAR) AS trace_id FROM conversations),
e AS (SELECT conv_id AS tid, CAST(conv_id AS VARCHAR) AS trace_id, turn AS n, concat_ws('-', conv_id, turn) AS event_id, role AS name, text FROM conversations)
"""
TEXTS_SQL = """WITH t AS (SELECT DISTINCT lang AS log_id, source AS tid, lang || '-' || source AS trace_id FROM documents),
e AS (SELECT lang AS log_id, source AS tid, lang || '-' || source AS trace_id, doc_id AS n, CAST(doc_id AS VARCHAR) AS event_id, source AS name, text, quality, n_chars AS size, CASE WHEN n_chars > 2000 THEN 'yes' ELSE 'no' END AS long FROM documents LEFT JOIN labels USING (doc_id))
"""
_BASE = {"orders": ORDERS_SQL, "clicks": CLICKS_SQL, "talks": TALKS_SQL, "texts": TEXTS_SQL}

QUERIES: dict[str, Registered] = {}


def add(name: str, store: str, text: str, level: str, columns: str | dict[str, str], sql: str | None, log_id: str | None = None) -> None:
    """Register a query; ``columns`` may be a list of names, where ``name=expression`` renames."""
    if isinstance(columns, str):
        columns = {n: e or n for n, _, e in (c.strip().partition("=") for c in columns.split(";"))}
    QUERIES[name] = Registered(store, text, level, columns, None if sql is None else _BASE[store] + sql, log_id)


def events(name: str, store: str, where: str, sql: str) -> None:
    """A filter whose remaining events are returned."""
    add(name, store, f"select e:name where {where}", "events", "log_id;trace_id;event_id;name=e_concept_name" if store != "talks" else "trace_id;event_id;name=e_concept_name", f"SELECT {'log_id, ' if store != 'talks' else ''}trace_id, event_id, name FROM e WHERE {sql}")


def traces(name: str, store: str, where: str, sql: str) -> None:
    """A filter whose remaining traces are returned."""
    add(name, store, f"select t:name where {where}", "traces", "log_id;trace_id", f"SELECT log_id, trace_id FROM t WHERE {sql}")


# -- scans and projections ------------------------------------------------------------------

add("p1_implicit_all", "orders", "", "flat", "log_id;trace_id;event_id;name=e_concept_name;ts=e_time_timestamp;total=round(t_cost_total, 2);priority=t_o_orderpriority", "SELECT e.log_id, e.trace_id, e.event_id, e.name, e.ts, round(t.total, 2) AS total, t.o_orderpriority AS priority FROM e JOIN t USING (log_id, tid)")
add("p2_select_star", "talks", "select *", "flat", "trace_id;event_id;role=e_concept_name;text=e_text", "SELECT trace_id, event_id, name AS role, text FROM e")
add("p3_scoped_star", "orders", "select t:*", "traces", "log_id;trace_id;total=round(t_cost_total, 2);status=t_o_orderstatus", "SELECT log_id, trace_id, round(total, 2) AS total, o_orderstatus AS status FROM t")
add("p4_attributes", "orders", "select l:name, t:name, e:name, e:timestamp", "flat", "l_name=l_concept_name;t_name=t_concept_name;e_name=e_concept_name;ts=e_time_timestamp", "SELECT log_id AS l_name, trace_id AS t_name, name AS e_name, ts FROM e")
add("p5_cross_scope_expression", "orders", "select e:total / t:total, [e:l_quantity] * (1 - [e:l_discount])", "events", "event_id;share=round(col_0, 6);qty=round(col_1, 6)", "SELECT event_id, round(e.total / t.total, 6) AS share, round(l_quantity * (1 - l_discount), 6) AS qty FROM e JOIN t USING (log_id, tid)")
add("p6_scoped_literals", "orders", "select l:1, l:2 + t:3, l:4 * t:5 + e:6, 7 / 8 - 9, 10 * null, t:null/11, l:D2020-03-12", "flat", "event_id;a=col_0;b=col_1;c=col_2;d=col_3;e=col_4;f=col_5;g=col_6", "SELECT event_id, 1.0::DOUBLE AS a, 5.0::DOUBLE AS b, 26.0::DOUBLE AS c, -8.125::DOUBLE AS d, NULL::DOUBLE AS e, NULL::DOUBLE AS f, TIMESTAMP '2020-03-12 00:00:00' AS g FROM e")
add("p7_classifier_columns", "orders", "select c:Status, c:Flag", "events", "event_id;flag=e_l_returnflag;status=e_l_linestatus", "SELECT event_id, l_returnflag AS flag, l_linestatus AS status FROM e")
add("p8_group_projection", "orders", "group by e:name", "events", "log_id;trace_id;name=e_concept_name", "SELECT DISTINCT log_id, trace_id, name FROM e")
add("p9_null_events", "orders", "select l:name limit e:3 offset e:1", "placeholders", "log_id;trace_id;empty=_null_event_count", "SELECT t.log_id, t.trace_id, least(3, greatest(0, count(e.n) - 1)) AS empty FROM t LEFT JOIN e USING (log_id, tid) GROUP BY t.log_id, t.tid, t.trace_id")
add("s1_log_by_id", "orders", "select count(^t:name)", "logs", "n=fn_0", "SELECT count(*) AS n FROM t WHERE log_id = 'BUILDING'", "BUILDING")
add("s3_all_logs", "orders", "select l:name", "logs", "name=l_concept_name", "SELECT log_id AS name FROM l")
add("s5_traces_with_events", "orders", "select t:name where e:total > 90000", "traces", "log_id;trace_id", "SELECT DISTINCT log_id, trace_id FROM e WHERE total > 90000")

# -- filters --------------------------------------------------------------------------------

events("f1_comparisons", "orders", "e:total >= 1000 and e:total < 20000 and e:name != 'RF' and [e:l_quantity] <= 40 and [e:l_tax] > 0.01", "total >= 1000 AND total < 20000 AND name <> 'RF' AND l_quantity <= 40 AND l_tax > 0.01")
events("f2_boolean_operators", "orders", "not(e:name = 'NO') and (e:total > 50000 or [e:l_discount] = 0.0) and not e:resource = '1'", "NOT (name = 'NO') AND (total > 50000 OR l_discount = 0) AND NOT resource = '1'")
events("f3_is_null", "clicks", "[e:k] is not null and e:resource is null", "k IS NOT NULL")
events("f4_in_lists", "clicks", "e:name in ('purchase', 'click') and [e:k] not in (1, 2, 3)", "name IN ('purchase', 'click') AND k NOT IN (1, 2, 3)")
events("f4_in_with_columns", "orders", "[e:l_linestatus] in ([e:l_returnflag], 'F')", "l_linestatus IN (l_returnflag, 'F')")
events("f5_like_contains", "talks", "[e:text] like '%and%'", "contains(text, 'and')")
events("f5_like_wildcards", "talks", "[e:text] like '_h%the_%'", "text LIKE '_h%the_%'")
events("f5_like_prefix_suffix", "talks", "[e:text] like 'Th%' and [e:text] like '%.'", "text LIKE 'Th%' AND text LIKE '%.'")
events("f5_like_escapes", "texts", r"[e:text] like '%\%\%\%%' or [e:text] like '%a\_b%'", "contains(text, '%%%') OR contains(text, 'a_b')")
events("f6_not_like", "clicks", "not(e:name like 'p%')", "NOT (name LIKE 'p%')")
events("f7_matches", "talks", "[e:text] matches '[Tt]h(e|at)[.,]'", "regexp_matches(text, '[Tt]h(e|at)[.,]', 's')")
add("f8_event_scope", "orders", "select l:name, t:name where e:name = 'RF' and e:total > 80000", "traces", "log_id;trace_id;name=t_concept_name", "SELECT DISTINCT log_id, trace_id, trace_id AS name FROM e WHERE name = 'RF' AND total > 80000")
add("f9_trace_scope", "orders", "select e:name where t:total > 250000", "events", "trace_id;event_id;name=e_concept_name", "SELECT trace_id, event_id, name FROM e WHERE tid IN (SELECT tid FROM t WHERE total > 250000)")
add("f10_log_scope", "orders", "select e:name where l:name = 'MACHINERY'", "events", "trace_id;event_id", "SELECT trace_id, event_id FROM e WHERE log_id = 'MACHINERY'")
add("f11_cross_scope", "orders", "select e:total where e:total * 2 > t:total and [t:o_orderstatus] != [e:l_linestatus]", "events", "event_id;total=round(e_cost_total, 2)", "SELECT event_id, round(e.total, 2) AS total FROM e JOIN t USING (log_id, tid) WHERE e.total * 2 > t.total AND o_orderstatus <> l_linestatus")
traces("f12_trace_hoist", "orders", "^e:name = 'RF' and ^e:total > 50000", "tid IN (SELECT tid FROM e WHERE name = 'RF' AND total > 50000)")
add("f12_trace_hoist_keeps_events", "orders", "select e:name where ^e:total > 95000", "events", "trace_id;event_id", "SELECT trace_id, event_id FROM e WHERE tid IN (SELECT tid FROM e WHERE total > 95000)")
add("f13_log_hoist", "orders", "select l:name where ^^e:total > 100000 and ^^e:name = 'AF'", "logs", "name=l_concept_name", "SELECT DISTINCT log_id AS name FROM e WHERE total > 100000 AND name = 'AF'")
traces("f14_not_inside_hoist", "orders", "not(^e:name = 'NO')", "tid IN (SELECT tid FROM e WHERE NOT (name = 'NO'))")
traces("f14_cross_scope_hoist", "orders", "not([t:o_orderstatus] = [^e:l_linestatus]) and t:total < 100000", "total < 100000 AND EXISTS (SELECT 1 FROM e WHERE e.tid = t.tid AND NOT (t.o_orderstatus = e.l_linestatus))")
add("f15_trace_to_log_hoist", "orders", "select l:name where ^t:total > 400000", "logs", "name=l_concept_name", "SELECT DISTINCT log_id AS name FROM t WHERE total > 400000")
add("f_two_bindings", "orders", "select e:name where e:name = 'NO' and ^e:name = 'RF' and ^e:total > 60000", "events", "event_id;name=e_concept_name", "SELECT event_id, name FROM e WHERE name = 'NO' AND EXISTS (SELECT 1 FROM e x WHERE x.tid = e.tid AND x.name = 'RF' AND x.total > 60000)")
add("f16_members_under_aggregate", "orders", "select count(t:name) where e:name = 'RF'", "traces", "log_id;n=fn_0", "SELECT log_id, count(DISTINCT tid) AS n FROM e WHERE name = 'RF' GROUP BY log_id")
add("f17_classifier_guard", "texts", "select count(e:name) group by c:Quality", "events", "log_id;trace_id;n=fn_0", "SELECT log_id, trace_id, count(name) AS n FROM e WHERE quality IS NOT NULL GROUP BY log_id, trace_id, quality")
add("f19_constant", "orders", "where 0=1", "logs", "log_id", "SELECT log_id FROM l WHERE false")
events("f_dates", "orders", "e:timestamp >= D1997-01-01 and e:timestamp < D1997-06-30T12:00+0200", "ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1997-06-30 10:00:00'")
events("f_dayofweek", "orders", "dayofweek(e:timestamp) in (1, 7)", "dayofweek(ts) IN (0, 6)")

# -- scalar functions -----------------------------------------------------------------------

add("x_date_parts", "clicks", "select year(e:timestamp), month(e:timestamp), day(e:timestamp), hour(e:timestamp), minute(e:timestamp), second(e:timestamp), millisecond(e:timestamp), quarter(e:timestamp), dayofweek(e:timestamp)", "events", "event_id;" + ";".join(f"c{i}=fn_{i}" for i in range(9)), "SELECT event_id, year(ts)::DOUBLE AS c0, month(ts)::DOUBLE AS c1, day(ts)::DOUBLE AS c2, hour(ts)::DOUBLE AS c3, minute(ts)::DOUBLE AS c4, second(ts)::DOUBLE AS c5, (millisecond(ts) % 1000)::DOUBLE AS c6, quarter(ts)::DOUBLE AS c7, (dayofweek(ts) + 1)::DOUBLE AS c8 FROM e")
add("x_date_and_time", "clicks", "select date(e:timestamp), time(e:timestamp)", "events", "event_id;d=cast(fn_0 as string);t=fn_1", "SELECT event_id, CAST(ts::DATE AS VARCHAR) AS d, strftime(ts, '%H:%M:%S.%g') AS t FROM e")
add("x_text", "talks", "select upper(e:name), lower([e:text])", "events", "event_id;u=fn_0;l=fn_1", "SELECT event_id, upper(name) AS u, lower(text) AS l FROM e")
add("x_round", "orders", "select round(e:total), round(0 - [e:l_quantity] / 2)", "events", "event_id;r=fn_0;h=fn_1", "SELECT event_id, floor(total + 0.5) AS r, floor((0 - l_quantity / 2) + 0.5) AS h FROM e")
add("x_arithmetic", "orders", "select (e:total + 1) * 2 - [e:l_tax] / [e:l_discount]", "events", "event_id;v=round(col_0, 6)", "SELECT event_id, round((total + 1) * 2 - l_tax / CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END, 6) AS v FROM e")
add("x_concat", "orders", "select [e:l_returnflag] + e:resource, e:name + '!'", "events", "event_id;a=col_0;b=col_1", "SELECT event_id, l_returnflag || resource AS a, name || '!' AS b FROM e")
add("x_null_propagation", "orders", "select e:total + null, t:total * null", "flat", "event_id;a=col_0;b=col_1", "SELECT event_id, NULL::DOUBLE AS a, NULL::DOUBLE AS b FROM e")
add("x_negative_numbers", "orders", "select e:total * -1.5e0, -2 + e:total", "events", "event_id;a=round(col_0, 4);b=round(col_1, 4)", "SELECT event_id, round(total * -1.5, 4) AS a, round(total - 2, 4) AS b FROM e")
add("x_now", "orders", "select now()", "events", "event_id;kind=typeof(fn_0);near=fn_0 between current_timestamp() - interval 1 day and current_timestamp() + interval 1 day", "SELECT event_id, 'timestamp' AS kind, true AS near FROM e")

# -- aggregates and groups ------------------------------------------------------------------

add("a1_counts", "orders", "select count(l:name), count(^t:name), count(^^e:name)", "logs", "l=fn_0;t=fn_1;e=fn_2", "SELECT (SELECT count(*) FROM l) AS l, (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM e) AS e")
add("a2_sum_null", "clicks", "select sum(e:total), count(e:resource), sum([e:nothing]) where [e:k] > 5", "events", "trace_id;s=round(fn_0, 6);n=fn_1;z=fn_2", "SELECT trace_id, round(sum(total), 6) AS s, 0::BIGINT AS n, NULL::DOUBLE AS z FROM e WHERE k > 5 GROUP BY trace_id")
add("a3_avg_of_values", "orders", "select avg(^e:total)", "traces", "log_id;a=round(fn_0, 6)", "SELECT log_id, round(avg(total), 6) AS a FROM e GROUP BY log_id")
add("a4_min_max", "orders", "select min(e:name), max(e:timestamp), min(e:total)", "events", "log_id;trace_id;a=fn_0;b=fn_1;c=round(fn_2, 2)", "SELECT log_id, trace_id, min(name) AS a, max(ts) AS b, round(min(total), 2) AS c FROM e GROUP BY log_id, trace_id")
add("a5_scope_prefix", "orders", "select t:min(l:name)", "traces", "v=fn_0", "SELECT log_id AS v FROM l WHERE log_id IN (SELECT log_id FROM t)")
add("a7_implicit_trace", "orders", "select count(t:name), sum(t:total)", "traces", "log_id;n=fn_0;s=round(fn_1, 2)", "SELECT log_id, count(*) AS n, round(sum(total), 2) AS s FROM t GROUP BY log_id")
add("a8_implicit_log", "orders", "select sum(^^e:total), avg(^t:total)", "logs", "s=round(fn_0, 2);a=round(fn_1, 6)", "SELECT (SELECT round(sum(total), 2) FROM e) AS s, (SELECT round(avg(total), 6) FROM t) AS a")
add("a9_event_groups", "orders", "select e:name, count(e:name), sum(e:total) group by e:name", "events", "log_id;trace_id;name=e_concept_name;n=fn_1;s=round(fn_2, 2)", "SELECT log_id, trace_id, name, count(*) AS n, round(sum(total), 2) AS s FROM e GROUP BY log_id, trace_id, name")
add("a10_bare_event_groups", "clicks", "group by e:name", "events", "trace_id;name=e_concept_name", "SELECT trace_id, name FROM e GROUP BY trace_id, name")
add("a11_trace_groups_by_position", "orders", "select [t:o_orderstatus], count(^e:name), sum(e:total) group by [t:o_orderstatus]", "events", "log_id;n_pos=_pos;s=round(fn_2, 2)", "SELECT log_id, 1::BIGINT AS n_pos, round(sum(e.total), 2) AS s FROM e JOIN (SELECT tid, o_orderstatus FROM t) t USING (tid) GROUP BY log_id, o_orderstatus")
add("a11_positional_merge", "orders", "select count(t:name) group by [t:o_orderstatus] limit t:3", "traces", "log_id;n=fn_0;members=_trace_count", "SELECT log_id, count(*) AS n, count(*) AS members FROM t GROUP BY log_id, o_orderstatus")
add("a12_log_groups", "orders", "select l:name, count(^t:name), sum(^^e:total) group by l:name", "logs", "name=l_concept_name;n=fn_1;s=round(fn_2, 2)", "SELECT log_id AS name, (SELECT count(*) FROM t WHERE t.log_id = l.log_id) AS n, (SELECT round(sum(total), 2) FROM e WHERE e.log_id = l.log_id) AS s FROM l")
_VARIANTS = "v AS (SELECT t.log_id, t.tid, coalesce(string_agg(name, '>' ORDER BY n), '') AS seq, count(e.name) AS c FROM t LEFT JOIN e USING (log_id, tid) GROUP BY ALL)"
add("a13_variants", "orders", "select count(t:name), count(^e:name) group by ^e:name", "traces", "log_id;n=fn_0;e=fn_1;members=_trace_count", f", {_VARIANTS} SELECT log_id, count(*) AS n, sum(c)::BIGINT AS e, count(*) AS members FROM v GROUP BY log_id, seq")
add("a13_click_variants", "clicks", "select count(t:name) group by ^e:name", "traces", "n=fn_0", ", v AS (SELECT tid, string_agg(name, '>' ORDER BY ts, n) AS seq FROM e GROUP BY tid) SELECT count(*) AS n FROM v GROUP BY seq")
add("a14_unordered_variants", "orders", "select count(t:name) group by ^e:name order by e:name", "traces", "log_id;n=fn_0", ", v AS (SELECT t.log_id, t.tid, coalesce(string_agg(name, '>' ORDER BY name), '') AS seq FROM t LEFT JOIN e USING (log_id, tid) GROUP BY ALL) SELECT log_id, count(*) AS n FROM v GROUP BY log_id, seq")
add("a15_variant_events", "orders", "select l:name, count(t:name), e:name group by ^e:name order by count(t:name) desc limit t:3", "events", "log_id;pos=_pos;name=e_concept_name", f", {_VARIANTS}, g AS (SELECT log_id, seq, count(*) AS n, min(tid) AS first, row_number() OVER (PARTITION BY log_id ORDER BY count(*) DESC, min(tid)) AS rn FROM v WHERE c > 0 GROUP BY log_id, seq) SELECT g.log_id, row_number() OVER (PARTITION BY g.log_id, first ORDER BY e.n) AS pos, e.name FROM g JOIN e ON e.tid = g.first WHERE rn <= 3")
add("a16_variant_aggregates", "orders", "select min(^e:total), max(^e:total), sum(^e:total), avg(^e:total) group by ^e:name", "traces", "log_id;a=round(fn_0, 2);b=round(fn_1, 2);c=round(fn_2, 2);d=round(fn_3, 6)", f", {_VARIANTS} SELECT v.log_id, round(min(total), 2) AS a, round(max(total), 2) AS b, round(sum(total), 2) AS c, round(avg(total), 6) AS d FROM v LEFT JOIN e USING (log_id, tid) GROUP BY v.log_id, seq")
add("a18_variants_and_keys", "orders", "select [t:o_orderstatus], count(t:name) group by [t:o_orderstatus], ^e:name", "traces", "log_id;status=t_o_orderstatus;n=fn_1", f", {_VARIANTS} SELECT log_id, o_orderstatus AS status, count(*) AS n FROM v JOIN t USING (log_id, tid) GROUP BY log_id, o_orderstatus, seq")
add("a19_log_sequences", "texts", "select count(l:name), count(^^e:name) where [e:size] > 6000 and t:name = 'src12' group by [^^e:long], ^^e:name", "logs", "n=fn_0;e=fn_1", ", s AS (SELECT log_id, string_agg(long, '>' ORDER BY tid, n) AS a, string_agg(name, '>' ORDER BY tid, n) AS b FROM e WHERE size > 6000 AND tid = 'src12' GROUP BY log_id) SELECT count(DISTINCT log_id) AS n, count(e.name) AS e FROM s JOIN e USING (log_id) GROUP BY a, b")
add("a20_classifier_variants", "orders", "select count(t:name) group by ^c:Status", "traces", "log_id;n=fn_0", f", {_VARIANTS} SELECT log_id, count(*) AS n FROM v WHERE c > 0 GROUP BY log_id, seq")
add("a21_populations", "orders", "select sum(^e:total), count(t:name), sum(e:total) where e:name = 'RF'", "traces", "log_id;whole=round(fn_0, 2);n=fn_1", "SELECT log_id, round(sum(total), 2) AS whole, count(DISTINCT tid) AS n FROM e WHERE tid IN (SELECT tid FROM e WHERE name = 'RF') GROUP BY log_id")
add("a21_matching_only", "orders", "select sum(^e:total), sum(e:total) where e:name = 'RF' and e:total > 1000", "events", "log_id;s=round(fn_1, 2)", "SELECT log_id, round(sum(total), 2) AS s FROM e WHERE name = 'RF' AND total > 1000 GROUP BY log_id")
add("a22_order_population", "orders", "select l:name, sum(^^e:total) where e:name = 'RF' group by l:name order by sum(^^e:total) desc limit l:2", "logs", "pos=_pos;name=l_concept_name;s=round(fn_1, 2)", "SELECT row_number() OVER (ORDER BY matched DESC) AS pos, log_id AS name, s FROM (SELECT log_id, sum(total) FILTER (name = 'RF') AS matched, round(sum(total), 2) AS s FROM e GROUP BY log_id) ORDER BY matched DESC LIMIT 2")
add("a23_filtered_sequences", "orders", "select count(t:name), count(^e:name) where e:total > 40000 group by ^e:name", "traces", "log_id;n=fn_0;e=fn_1", ", m AS (SELECT log_id, tid, string_agg(name, '>' ORDER BY n) AS seq FROM e WHERE total > 40000 GROUP BY log_id, tid), c AS (SELECT tid, count(*) AS c FROM e GROUP BY tid) SELECT log_id, count(*) AS n, sum(c)::BIGINT AS e FROM m JOIN c USING (tid) GROUP BY log_id, seq")
add("a24_mixed_scopes", "orders", "select count(^^e:name), count(^e:name), count(e:name) where e:name = 'RF'", "flat", "a=fn_0;b=fn_1;c=fn_2", "SELECT (SELECT count(*) FROM e WHERE log_id IN (SELECT log_id FROM e WHERE name = 'RF')) AS a, (SELECT count(*) FROM e WHERE tid IN (SELECT tid FROM e WHERE name = 'RF')) AS b, (SELECT count(*) FROM e WHERE name = 'RF') AS c")
add("a25_hoisted_beside_event_groups", "orders", "select t:name, max(^e:timestamp)-min(^e:timestamp), e:name, count(e:name) group by t:name, e:name", "flat", "log_id;name=t_concept_name;days=col_1;e=e_concept_name;n=fn_3", "SELECT log_id, trace_id AS name, days, name AS e, n FROM (SELECT log_id, tid, trace_id, name, count(*) AS n FROM e GROUP BY ALL) JOIN (SELECT tid, (epoch(max(ts)) - epoch(min(ts))) / 86400.0 AS days FROM e GROUP BY tid) USING (tid)")
add("a26_duration", "clicks", "select max(e:timestamp) - min(e:timestamp)", "events", "trace_id;days=round(col_0, 9)", "SELECT trace_id, round(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) / 86400.0, 9) AS days FROM e GROUP BY trace_id")
add("a27_aggregate_arithmetic", "orders", "select (sum(e:total) - min(e:total)) / count(e:name) * 2", "events", "log_id;trace_id;v=round(col_0, 6)", "SELECT log_id, trace_id, round((sum(total) - min(total)) / count(name) * 2, 6) AS v FROM e GROUP BY log_id, trace_id")
add("a29_order_only_aggregate", "orders", "order by avg(e:total) limit l:2", "logs", "log_id;pos=_pos", "SELECT log_id, row_number() OVER (ORDER BY a) AS pos FROM (SELECT log_id, min(a) AS a FROM (SELECT log_id, tid, avg(total) AS a FROM e GROUP BY ALL) GROUP BY log_id) ORDER BY a LIMIT 2")
add("a31_traces_without_events", "orders", "select count(t:name), count(^e:name), sum(t:total) where t:total < 200000 group by [t:o_orderstatus], ^e:name", "traces", "log_id;n=fn_0;e=fn_1;s=round(fn_2, 2)", f", {_VARIANTS} SELECT v.log_id, count(*) AS n, sum(c)::BIGINT AS e, round(sum(t.total), 2) AS s FROM v JOIN t USING (log_id, tid) WHERE t.total < 200000 GROUP BY v.log_id, t.o_orderstatus, seq")
add("a32_null_events_of_groups", "orders", "select count(t:name) where e:total > 30000 group by ^e:name", "placeholders", "log_id;n=fn_0;empty=_null_event_count", ", m AS (SELECT log_id, tid, string_agg(name, '>' ORDER BY n) AS seq, count(*) AS c FROM e WHERE total > 30000 GROUP BY log_id, tid) SELECT log_id, count(*) AS n, max(c) AS empty FROM m GROUP BY log_id, seq")

# -- order, limit, offset -------------------------------------------------------------------

add("o1_default_order", "orders", "select t:name limit l:2, t:5", "traces", "log_id;trace_id;pos=_pos", "SELECT log_id, trace_id, rn AS pos FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY tid) AS rn, dense_rank() OVER (ORDER BY log_id) AS ln FROM t) WHERE rn <= 5 AND ln <= 2")
add("o2_keys_by_scope", "orders", "select t:name, e:name order by e:total desc, t:total limit l:2, t:3, e:2", "flat", "log_id;trace_id;event_id;t_pos=_t_pos;e_pos=_e_pos", "SELECT log_id, trace_id, event_id, tn AS t_pos, en AS e_pos FROM (SELECT e.*, row_number() OVER (PARTITION BY e.tid ORDER BY e.total DESC NULLS FIRST, e.n) AS en FROM e) e JOIN (SELECT log_id, tid, row_number() OVER (PARTITION BY log_id ORDER BY total NULLS LAST, tid) AS tn FROM t) USING (log_id, tid) JOIN (SELECT log_id, row_number() OVER (ORDER BY min(total) NULLS LAST, log_id) AS ln FROM t GROUP BY log_id) USING (log_id) WHERE tn <= 3 AND en <= 2 AND ln <= 2")
add("o3_descending", "clicks", "select e:name order by e:timestamp desc, e:id limit e:3", "events", "trace_id;event_id;pos=_pos", "SELECT trace_id, event_id, rn AS pos FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY ts DESC NULLS FIRST, event_id) AS rn FROM e) WHERE rn <= 3")
add("o4_null_is_largest", "clicks", "select e:name order by e:resource desc, [e:k], e:timestamp limit e:4", "events", "trace_id;event_id;pos=_pos", "SELECT trace_id, event_id, rn AS pos FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY CAST(CAST(k AS BIGINT) AS VARCHAR) NULLS LAST, ts, n) AS rn FROM e) WHERE rn <= 4")
add("o5_order_by_expression", "orders", "select e:name order by [e:l_quantity] * [e:l_tax] desc limit e:2", "events", "trace_id;event_id;pos=_pos", "SELECT trace_id, event_id, rn AS pos FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY l_quantity * l_tax DESC NULLS FIRST, n) AS rn FROM e) WHERE rn <= 2")
add("o6_order_by_aggregate", "orders", "select [t:o_orderpriority], sum(^e:total) group by [t:o_orderpriority] order by sum(^e:total) desc limit t:3", "traces", "log_id;pos=_pos;priority=t_o_orderpriority", "SELECT log_id, rn AS pos, o_orderpriority AS priority FROM (SELECT e.log_id, o_orderpriority, row_number() OVER (PARTITION BY e.log_id ORDER BY sum(e.total) DESC) AS rn FROM e JOIN (SELECT tid, o_orderpriority FROM t) t USING (tid) GROUP BY e.log_id, o_orderpriority) WHERE rn <= 3")
add("o7_order_by_event_aggregate", "orders", "select e:name, sum(e:total) group by e:name order by sum(e:total) desc limit e:1", "events", "log_id;trace_id;name=e_concept_name", "SELECT log_id, trace_id, name FROM (SELECT log_id, trace_id, name, row_number() OVER (PARTITION BY tid ORDER BY sum(total) DESC, min(n)) AS rn FROM e GROUP BY log_id, tid, trace_id, name) WHERE rn = 1")
add("o8_hierarchical_limit", "clicks", "select e:name limit l:1, t:10, e:5", "events", "trace_id;event_id;pos=row_number() over (partition by trace_id order by _pos)", "SELECT trace_id, event_id, rn AS pos FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY ts, n) AS rn, dense_rank() OVER (ORDER BY tid) AS tn FROM e) WHERE rn <= 5 AND tn <= 10")
add("o9_hierarchical_offset", "orders", "select t:name, e:name limit l:3, t:10, e:2 offset l:1, t:2, e:1", "flat", "log_id;trace_id;event_id", "SELECT log_id, trace_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY n) AS en, dense_rank() OVER (PARTITION BY log_id ORDER BY tid) AS tn FROM e) JOIN (SELECT log_id, row_number() OVER (ORDER BY log_id) AS ln FROM l) USING (log_id) WHERE en BETWEEN 2 AND 3 AND ln BETWEEN 2 AND 4 AND (log_id, tid) IN (SELECT (log_id, tid) FROM (SELECT log_id, tid, row_number() OVER (PARTITION BY log_id ORDER BY tid) AS x FROM t) WHERE x BETWEEN 3 AND 12)")
add("o9_offset_keeps_parents", "talks", "select t:name offset e:1000", "traces", "trace_id", "SELECT trace_id FROM t")
add("o12_log_ranking", "orders", "select e:name order by e:timestamp, e:name limit l:1, t:2, e:2", "logs", "log_id", "SELECT log_id FROM e GROUP BY log_id ORDER BY min((ts, name)), log_id LIMIT 1")
add("o13_filter_before_limit", "clicks", "select e:name where e:name = 'purchase' limit l:1, t:10, e:5", "events", "trace_id;event_id", "SELECT trace_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY ts, n) AS rn, dense_rank() OVER (ORDER BY tid) AS tn FROM e WHERE name = 'purchase') WHERE rn <= 5 AND tn <= 10")
add("o14_aggregate_before_limit", "orders", "select count(t:name) limit t:1, e:1", "placeholders", "log_id;n=fn_0;empty=_null_event_count", "SELECT log_id, count(*) AS n, least(1, max(c)) AS empty FROM (SELECT t.log_id, t.tid, count(e.n) AS c FROM t LEFT JOIN e USING (log_id, tid) GROUP BY t.log_id, t.tid) GROUP BY log_id")
add("o15_window_then_aggregate", "orders", "select min(e:timestamp), max(e:timestamp) limit l:2, t:10", "events", "log_id;trace_id;a=fn_0;b=fn_1", "SELECT log_id, trace_id, min(ts) AS a, max(ts) AS b FROM e WHERE (log_id, tid) IN (SELECT (log_id, tid) FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY tid) AS tn, dense_rank() OVER (ORDER BY log_id) AS ln FROM t) WHERE tn <= 10 AND ln <= 2) GROUP BY log_id, tid, trace_id")


# -- beyond reading -------------------------------------------------------------------------


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data store of two of the logs."""
    store = adapters.orders(spark, sf_dir)
    logs = store.logs.where(F.col("log_id").isin("AUTOMOBILE", "MACHINERY"))
    return execute(store.only(logs=logs), "select l:name, count(^e:name) group by l:name, t:name").flat().select(F.col("l_concept_name").alias("name"), F.col("fn_1").alias("n"))


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caps of interactive reads, which the query's own limit lowers."""
    return execute(adapters.clickstream(spark, sf_dir), "select e:name limit e:4", limits=DEFAULT_LIMITS).events.select("trace_id", "event_id")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.orders(spark, sf_dir).statistics()


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt hierarchy, as sizes and names of every trace."""
    rows = execute(adapters.dialogues(spark, sf_dir), "select t:name, e:name").nested()
    trace = rows.select(F.explode("traces").alias("t"))
    return trace.select(F.col("t.t_concept_name").alias("name"), F.size("t.events").cast("long").alias("n"), F.array_join(F.transform("t.events", lambda e: e["e_concept_name"]), ">").alias("roles"))


def rest(query: str, level: Scope):
    """What a delete query leaves of a level."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept, _ = without(adapters.orders(spark, sf_dir), query)
        return kept.levels[level].select(*IDS[level][1:])

    return run


def through_xes(spark: SparkSession, store, compress: bool = True):
    """A store whose logs are written as XES documents and read back, and the documents."""
    paths = to_xes_each(execute(store, ""), shared_file(spark, "documents"), compress)
    return read_xes(spark, paths), paths


def xes_events(compress: bool):
    """Events of dialogues that went through a XES document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store, _ = through_xes(spark, adapters.dialogues(spark, sf_dir), compress)
        found = execute(store, "select t:name, e:name, [e:text]").flat()
        return found.select(F.col("t_concept_name").alias("trace"), F.col("e_concept_name").alias("role"), F.col("e_text").alias("text"))

    return run


def xes_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by a classifier that a XES document declares, over its typed values."""
    store, _ = through_xes(spark, adapters.texts(spark, sf_dir))
    found = execute(store, "select l:name, t:name, [e:quality], count(e:name) group by l:name, t:name, c:Quality").flat()
    return found.select(F.col("l_concept_name").alias("log"), F.col("t_concept_name").alias("trace"), F.col("fn_3").alias("n"))


def json_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of the JSON document of the dialogues' log, which is written and read back."""
    paths = to_json_each(execute(adapters.dialogues(spark, sf_dir), "select t:name, e:name"), shared_file(spark, "json"))
    one = "struct<`@key`:string,`@value`:string>"
    schema = f"log struct<trace:array<struct<string:{one},event:array<struct<string:{one}>>>>>"
    trace = spark.read.schema(schema).json(paths).select(F.explode("log.trace").alias("t"))
    return trace.select(F.col("t.string.@value").alias("name"), F.size("t.event").cast("long").alias("n"), F.array_join(F.col("t.event.string.@value"), ">").alias("roles"))


def catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a log that a catalog imported, and deleted some of."""
    _, (path,) = through_xes(spark, adapters.dialogues(spark, sf_dir))
    catalog = Catalog(spark, shared_file(spark, "catalog"))
    store = catalog.create("talks")["id"]
    log = catalog.import_xes(store, path)
    catalog.delete("delete event where e:name = 'assistant'", store=store)
    found = catalog.query("select t:name, e:name", log_id=log).flat()
    return found.select(F.col("t_concept_name").alias("trace"), F.col("e_concept_name").alias("role"))


def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many components a delete query takes at each level."""
    _, gone = without(adapters.orders(spark, sf_dir), "delete trace where t:total < 100000 and ^e:name = 'RF'")
    counts = [gone.levels[s].agg(F.lit(s.label).alias("scope"), F.count(F.lit(1)).alias("n")) for s in Scope if s in gone.levels]
    return counts[0].unionByName(counts[1]).where("n > 0")


CUSTOM: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "s2_datastore_scan": (attached, ORDERS_SQL + "SELECT log_id AS name, count(e.n) AS n FROM t LEFT JOIN e USING (log_id, tid) WHERE log_id IN ('AUTOMOBILE', 'MACHINERY') GROUP BY log_id, tid"),
    "s19_log_statistics": (statistics, ORDERS_SQL + "SELECT log_id, (SELECT count(*) FROM t WHERE t.log_id = l.log_id) AS traces, (SELECT count(*) FROM e WHERE e.log_id = l.log_id) AS events FROM l"),
    "k2_hierarchy": (nested, TALKS_SQL + "SELECT trace_id AS name, count(*) AS n, string_agg(name, '>' ORDER BY n) AS roles FROM e GROUP BY trace_id"),
    "o11_default_caps": (capped, CLICKS_SQL + "SELECT trace_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY ts, n) AS rn, dense_rank() OVER (ORDER BY tid) AS tn FROM e) WHERE rn <= 4 AND tn <= 30"),
    "m1_delete_events": (rest("delete where e:name = 'RF' or e:total > 80000", Scope.EVENT), ORDERS_SQL + "SELECT trace_id, event_id FROM e WHERE NOT (name = 'RF' OR total > 80000)"),
    "m1_delete_traces_cascades": (rest("delete trace where ^e:total > 90000 and t:total < 400000", Scope.EVENT), ORDERS_SQL + "SELECT trace_id, event_id FROM e WHERE tid NOT IN (SELECT e.tid FROM e JOIN t USING (tid) WHERE e.total > 90000 AND t.total < 400000)"),
    "s9_xes_document": (xes_events(False), TALKS_SQL + "SELECT trace_id AS trace, name AS role, text FROM e"),
    "s10_xes_gzip": (xes_events(True), TALKS_SQL + "SELECT trace_id AS trace, name AS role, text FROM e"),
    "s13_xes_classifier": (xes_classifier, TEXTS_SQL + "SELECT log_id AS log, tid AS trace, count(*) AS n FROM e WHERE quality IS NOT NULL GROUP BY log_id, tid, quality"),
    "k6_xes_json": (json_traces, TALKS_SQL + "SELECT trace_id AS name, count(*) AS n, string_agg(name, '>' ORDER BY n) AS roles FROM e GROUP BY trace_id"),
    "m3_catalog_import_and_delete": (catalogued, TALKS_SQL + "SELECT trace_id AS trace, name AS role FROM e WHERE name <> 'assistant'"),
    "m1_delete_counts": (delete_counts, ORDERS_SQL + ", d AS (SELECT tid FROM t WHERE total < 100000 AND tid IN (SELECT tid FROM e WHERE name = 'RF')) SELECT 'trace' AS scope, count(*) AS n FROM d UNION ALL SELECT 'event', count(*) FROM e WHERE tid IN (SELECT tid FROM d)"),
    "m1_delete_traces": (rest("delete trace where [t:o_orderstatus] = 'F'", Scope.TRACE), ORDERS_SQL + "SELECT trace_id FROM t WHERE o_orderstatus <> 'F'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()} | {name: run for name, (run, _) in CUSTOM.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql} | {name: sql for name, (_, sql) in CUSTOM.items()}
