"""Lexing, parsing, resolution and validation."""

from datetime import UTC, datetime

import pytest

from hierql.engine import features, validate
from hierql.errors import PqlError, Problem
from hierql.functions.catalog import Scope, Type
from hierql.plans.ast import Aggregate, Binary, In, IsNull, Literal, Match, Name, Not
from hierql.plans.compiler import Classifier, compile_query
from hierql.plans.parser import parse

CLASSIFIERS = [Classifier("Activity", ("concept:name",)), Classifier("Full", ("concept:name", "lifecycle:transition"))]


def where(text):
    return parse(f"where {text}").where


def plain(e):
    """An expression without places."""
    return e.text if not isinstance(e, Name) else f"{'^' * e.hoist}{e.scope.letter + ':' if e.scope is not None else ''}{e.name}"


def test_empty_query_selects_everything():
    q = parse("")
    assert q.implicit_all and q.stars == list(Scope)


def test_precedence():
    e = where("not [e:a] = 1 and [e:b] = 2 or [e:c] = 3")
    assert e.op == "or" and e.left.op == "and" and isinstance(e.left.left, Not)
    e = where("[e:a] + 2 * 3 = (1 + 2) * 3")
    assert e.left.op == "+" and e.left.right.op == "*" and e.right.op == "*" and e.right.left.op == "+"
    assert isinstance(where("((e:total) > 1)"), Binary)
    assert where("(e:total + 1) * 2 > 3 and (e:name = 'a' or e:name is null)").op == "and"


@pytest.mark.parametrize(
    ("text", "name"),
    [("e:name", ("name", Scope.EVENT, 0, False)), ("^^event:name", ("name", Scope.EVENT, 2, False)), ("[^e:x y]", ("x y", Scope.EVENT, 1, True)), ("[case:variant]", ("case:variant", None, 0, True)), ("c:Act", ("c:Act", None, 0, False)), ("^t:concept:name", ("concept:name", Scope.TRACE, 1, False)), ("min", ("min", None, 0, False))],
)
def test_names(text, name):
    n = parse(f"select {text}").columns[0]
    assert (n.name, n.scope, n.hoist, n.bracketed) == name


@pytest.mark.parametrize(
    ("text", "value", "kind", "scope"),
    [
        ("'it'", "it", Type.STRING, None),
        (r"'a\'b'", r"a\'b", Type.STRING, None),
        ('l:"x"', "x", Type.STRING, Scope.LOG),
        ("t:-1.5e3", -1500.0, Type.NUMBER, Scope.TRACE),
        ("true", True, Type.BOOLEAN, None),
        ("null", None, Type.NULL, None),
        ("D2020-03", datetime(2020, 3, 1, tzinfo=UTC), Type.DATETIME, None),
        ("D20200313", datetime(2020, 3, 13, tzinfo=UTC), Type.DATETIME, None),
        ("D2020-03-13T16:45+0200", datetime(2020, 3, 13, 14, 45, tzinfo=UTC), Type.DATETIME, None),
        ("D2020-03-13T16:45:50.123", datetime(2020, 3, 13, 16, 45, 50, 123000, UTC), Type.DATETIME, None),
        ("D20200313T164550Z", datetime(2020, 3, 13, 16, 45, 50, tzinfo=UTC), Type.DATETIME, None),
        ("8F2A8F2A-0000-1111-2222-333344445555", "8f2a8f2a-0000-1111-2222-333344445555", Type.ID, None),
    ],
)
def test_literals(text, value, kind, scope):
    e = parse(f"select {text}").columns[0]
    assert (e.value, e.type, e.scope) == (value, kind, scope)


def test_conditions():
    assert isinstance(where("e:name in ('a', e:resource, null)"), In)
    assert where("e:name not  in ('a')").negated and where("e:name is not\nnull") == IsNull(where("e:name is null").operand, True)
    assert where("e:name matches '^a'") == Match("matches", where("e:name like 'x'").operand, "^a")


def test_comments_and_windows():
    q = parse("limit e:3, t:2, l:1, e:5 -- last wins\noffset t:1 /* x\ny */ // end")
    assert q.limits == {Scope.EVENT: 5, Scope.TRACE: 2, Scope.LOG: 1} and q.offsets == {Scope.TRACE: 1}


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ("select", Problem.SyntaxError),
        ("SELECT e:name", Problem.SyntaxError),
        ("select 7-9", Problem.SyntaxError),
        ("where e:name <> 'a'", Problem.SyntaxError),
        ("where e:name like e:resource", Problem.SyntaxError),
        ("where true", Problem.SyntaxError),
        ("group by e:total + 1", Problem.SyntaxError),
        ("limit 3", Problem.ScopeRequired),
        ("limit e:0", Problem.PositiveIntegerRequired),
        ("offset t:-1", Problem.PositiveIntegerRequired),
        ("select e:nothing", Problem.NoSuchAttribute),
        ("select [l:logId], l:logID", Problem.NoSuchAttribute),
        ("where ^l:name = 'a'", Problem.NoHoistingBeyondLong),
        ("where [^l:name] = 'a'", Problem.NoHoistingBeyondLong),
        ("select ^e:name", Problem.ScopeHoistingInSelectOrOrderBy),
        ("order by ^e:name", Problem.ScopeHoistingInSelectOrOrderBy),
        ("select t:total, e:name group by e:name", None),
        ("select e:total group by e:name", Problem.AttributeNotInGroupBy),
        ("select e:name group by t:name", Problem.AttributeNotInGroupBy),
        ("select e:* group by t:name", Problem.MixedScopes),
        ("select * group by e:name", Problem.MixedScopes),
        ("select e:*, count(e:name)", Problem.ExplicitSelectAllWithImplicitGroupBy),
        ("select t:*, e:*, sum(^e:total)", Problem.ExplicitSelectAllWithImplicitGroupBy),
        ("select count(e:name), e:name", Problem.MissingAttributesInAggregation),
        ("where count(e:name) > 1", Problem.AggregationFunctionInWhere),
        ("where c:Activity = 'a'", Problem.ClassifierInWhere),
        ("group by l:c:Activity", Problem.ClassifierOnLog),
        ("group by c:Unknown", Problem.InvalidUseOfClassifiers),
        ("delete event limit e:1", Problem.SyntaxError),
        ("delete event group by e:name", Problem.SyntaxError),
    ],
)
def test_problems(text, problem):
    if problem is None:
        compile_query(text, CLASSIFIERS)
        return
    with pytest.raises(PqlError) as caught:
        compile_query(text, CLASSIFIERS)
    assert caught.value.problem == problem


def test_message_has_a_place():
    with pytest.raises(PqlError, match="Line 2 position 2: NoSuchAttribute — "):
        compile_query("select l:name,\n  e:nothing")


def test_ambiguous_classifiers_are_refused():
    with pytest.raises(PqlError) as caught:
        compile_query("group by c:A", [Classifier("A", ("x",)), Classifier("A", ("y",))])
    assert caught.value.problem == Problem.InvalidUseOfClassifiers


def test_classifiers_expand_and_guard():
    plan = compile_query("select c:Full, count(t:name) group by ^c:Full", CLASSIFIERS)
    assert [c.alias for c in plan.columns] == ["e_concept_name", "e_lifecycle_transition", "fn_2"]
    assert plan.where.text == "event:concept:name is not null and event:lifecycle:transition is not null"


def test_group_projection_of_implicit_select():
    plan = compile_query("group by ^e:name")
    assert plan.stars == {Scope.LOG} and [(c.scope, c.text) for c in plan.columns] == [(Scope.EVENT, "event:concept:name")]


def test_order_keys_of_implicit_groups_go():
    plan = compile_query("select count(e:name) order by e:total, t:name")
    assert [s for s, _, _ in plan.order_by] == [Scope.TRACE]


def test_canonical_texts():
    plan = compile_query("select count(^^e:name), max(^e:timestamp)-min(^e:timestamp), [e:concept:name] + e:resource, 7/8 - 9, l:D2020-03-12, t:min(l:name)")
    assert [c.text for c in plan.columns] == ["count(^^event:concept:name)", "max(^event:time:timestamp) - min(^event:time:timestamp)", "event:concept:name + event:org:resource", "7.0 / 8.0 - 9.0", "log:D2020-03-12T00:00:00Z", "trace:min(log:concept:name)"]
    assert [c.scope for c in plan.columns] == [Scope.LOG, Scope.TRACE, Scope.EVENT, Scope.EVENT, Scope.LOG, Scope.TRACE]


def test_same_columns_are_selected_once():
    assert len(compile_query("select e:name, e:concept:name, [e:name]").columns) == 1


def test_validate_and_features():
    assert validate("limit l:1") == [] and validate("limit 1")[0].problem == Problem.ScopeRequired
    assert "median" not in features()["aggregates"] and "now" in features()["functions"]


#: Query shapes that must compile, one for each combination of clauses and scopes.
CORPUS = [
    "",
    "limit t:7",
    "limit e:12, l:2",
    "offset l:1, e:4",
    "limit t:20 offset t:5, e:2",
    "order by t:total, t:name desc",
    "order by e:resource, t:name limit t:4, e:6",
    "order by l:name desc, e:cost:total limit l:2",
    "order by max(e:cost:total), count(e:resource)",
    "select avg(e:cost:total) group by ^^e:resource",
    "select e:resource, max(e:cost:total) group by ^^e:resource, e:resource",
    "select t:max(l:name) limit l:6",
    "select t:*, l:*, max(e:cost:total), avg(e:timestamp) limit t:9",
    "select count(^^e:resource), max(^^e:cost:total)",
    "group by ^e:resource order by e:resource desc",
    "select l:name, count(t:total), e:resource group by ^e:resource order by count(t:total) limit t:5",
    "select min(e:cost:total) group by ^e:resource order by max(^e:cost:total)",
    "select t:name, max(^e:cost:total) / min(^e:cost:total) group by t:name order by max(^e:cost:total) / min(^e:cost:total)",
    "where 2 < 1",
    "select now(), year(now()) limit t:1",
    "select l:name, e:*, t:name limit e:3",
    "select l:*, e:* where t:name like 'ord_r%'",
    "where month(^^e:timestamp) in (2, 3) and not t:total is null",
    "where (not([t:region] = [^e:region]) or ^e:timestamp < D2019-05-01) and e:resource is not null",
    "where e:name matches '^(ship|pack)' and l:name not in ('a', 'b')",
    "group by ^c:Full",
    "select c:Activity, sum(e:cost:total) group by c:Activity order by sum(e:cost:total) desc limit e:2",
]


@pytest.mark.parametrize("text", CORPUS)
def test_corpus_compiles(text):
    compile_query(text, CLASSIFIERS)


def test_aggregate_scope():
    plan = compile_query("select t:min(l:name), sum(^e:total)")
    assert [a.scope for a in plan.aggregates()] == [Scope.TRACE, Scope.TRACE] and all(isinstance(a, Aggregate) for a in plan.aggregates())
    assert isinstance(parse("select 1").columns[0], Literal)
