"""Resolution, validation and planning: from a parsed query to a logical plan."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from hierql.errors import PqlError, Problem
from hierql.functions.catalog import CLASSIFIER_PREFIXES, SCALARS, SYSTEM, Scope, Type, aggregate_type, standard

from .ast import Aggregate, Attribute, Binary, Call, IsNull, Literal, Name, Query, aggregates, attributes, rebuild, walk
from .parser import parse

#: A nested attribute is named by US, ``s``, its parent, US and its own key.
NESTED = re.compile("\x1fs([^\x1f]+)\x1f(.*)", re.DOTALL)


@dataclass(frozen=True)
class Classifier:
    name: str
    keys: tuple[str, ...]
    scope: Scope = Scope.EVENT


@dataclass
class Column:
    """A projected expression at its scope; ``alias`` is the output column."""

    scope: Scope
    expression: Any
    alias: str

    @property
    def text(self) -> str:
        return self.expression.text


@dataclass
class Plan:
    stars: set[Scope] = field(default_factory=set)
    columns: list[Column] = field(default_factory=list)
    where: Any = None
    group_by: list[Attribute] = field(default_factory=list)
    order_by: list[tuple[Scope, Any, bool]] = field(default_factory=list)
    limits: dict[Scope, int] = field(default_factory=dict)
    offsets: dict[Scope, int] = field(default_factory=dict)
    delete: Scope | None = None
    implicit_all: bool = False

    def keys_at(self, scope: Scope) -> list[Attribute]:
        return [k for k in self.group_by if k.scope == scope]

    def aggregates(self) -> list[Aggregate]:
        found = [a for c in self.columns for a in aggregates(c.expression)] + [a for _, e, _ in self.order_by for a in aggregates(e)]
        return list(dict.fromkeys(found))

    @property
    def grouped(self) -> bool:
        return bool(self.group_by or self.aggregates())


# -- resolution -----------------------------------------------------------------------------


class Resolver:
    """Names become attributes: scope, hoisting, catalog, classifiers."""

    def __init__(self, classifiers: Iterable[Classifier] = ()):
        self.classifiers: dict[tuple[Scope, str], set[tuple[str, ...]]] = {}
        for c in classifiers:
            self.classifiers.setdefault((c.scope, c.name), set()).add(tuple(c.keys))

    def attribute(self, n: Name) -> Attribute:
        base = n.scope if n.scope is not None else Scope.EVENT
        if n.hoist > base:
            raise PqlError(Problem.NoHoistingBeyondLong, n.at, f"{base.label} attributes cannot be hoisted by {n.hoist}")
        scope = Scope(base - n.hoist)
        for prefix in CLASSIFIER_PREFIXES:
            if n.name.startswith(prefix):
                return self.classifier(n, base, scope, n.name.removeprefix(prefix))
        if known := standard(base, n.name):
            return Attribute(known[0], base, scope, "standard", known[1], at=n.at)
        if not n.bracketed:
            if n.name == SYSTEM.get(base):
                return Attribute(n.name, base, scope, "system", Type.STRING, at=n.at)
            raise PqlError(Problem.NoSuchAttribute, n.at, f"{n.name} is no standard attribute of a {base.label}; write [{n.name}] for a custom one")
        nested = NESTED.fullmatch(n.name)
        return Attribute(n.name, base, scope, "custom", Type.UNKNOWN, path=nested.groups() if nested else (), at=n.at)

    def classifier(self, n: Name, base: Scope, scope: Scope, name: str) -> Attribute:
        if base == Scope.LOG:
            raise PqlError(Problem.ClassifierOnLog, n.at, "classifiers are of events and traces")
        found = self.classifiers.get((base, name), set())
        if len(found) != 1:
            raise PqlError(Problem.InvalidUseOfClassifiers, n.at, f"classifier {name} has {len(found) or 'no'} definition{'s' * (len(found) > 1)} here")
        return Attribute(n.name, base, scope, "classifier", Type.STRING, keys=next(iter(found)), at=n.at)

    def key(self, c: Attribute, key: str) -> Attribute:
        known = standard(c.base, key)
        return Attribute(known[0] if known else key, c.base, c.scope, "standard" if known else "custom", known[1] if known else Type.UNKNOWN, at=c.at)

    def expression(self, e: Any) -> Any:
        def change(x):
            if isinstance(x, Name):
                found = self.attribute(x)
                return self.key(found, found.keys[0]) if len(found.keys) == 1 else found
            return x

        return rebuild(e, change)

    def uses(self, e: Any) -> list[Attribute]:
        """Classifiers named in an unresolved expression."""
        names = [x for x in walk(e) if isinstance(x, Name)]
        return [a for a in map(self.attribute, names) if a.kind == "classifier"]


def type_of(e: Any) -> Type:
    if isinstance(e, (Attribute, Literal)):
        return e.type
    if isinstance(e, Call):
        return Type.DATETIME if e.function == "now" else SCALARS[e.function]
    if isinstance(e, Aggregate):
        return aggregate_type(e.function, type_of(e.argument))
    if isinstance(e, Binary) and e.op in "+-*/":
        kinds = {type_of(e.left), type_of(e.right)} & {Type.STRING, Type.ID, Type.TIME}
        return Type.STRING if e.op == "+" and kinds else Type.NUMBER
    return Type.BOOLEAN


def scope_of(e: Any) -> Scope:
    """An expression's scope: its deepest part's, by default EVENT."""
    found: list[Scope] = []
    for x in walk(e, into_aggregates=False):
        if isinstance(x, (Attribute, Aggregate)):
            found.append(x.scope)
        elif isinstance(x, (Literal, Call)) and x.scope is not None:
            found.append(x.scope)
    return max(found, default=Scope.EVENT)


# -- validation -----------------------------------------------------------------------------


def check_where(e: Any) -> None:
    for a in aggregates(e):
        raise PqlError(Problem.AggregationFunctionInWhere, a.at, f"{a.text} cannot stand in where")


def check_projected(plan: Plan) -> None:
    """No hoisting outside aggregates; grouped attributes must be keys."""
    expressions = [c.expression for c in plan.columns] + [e for _, e, _ in plan.order_by]
    for e in expressions:
        for a in attributes(e, into_aggregates=False):
            if a.hoisted:
                raise PqlError(Problem.ScopeHoistingInSelectOrOrderBy, a.at, f"{a.text} can be hoisted inside an aggregate only")
    for e in expressions:
        for a in attributes(e, into_aggregates=False):
            above = [plan.keys_at(Scope(s)) for s in range(a.base, -1, -1)]
            if any(above) and not any(k.base == a.base and (k.name == a.name or a.name in k.keys) for keys in above for k in keys):
                raise PqlError(Problem.AttributeNotInGroupBy, a.at, f"{a.text} must be a group key or be aggregated")


def check_stars(plan: Plan, at: tuple[int, int]) -> None:
    for star in plan.stars:
        if any(plan.keys_at(Scope(s)) for s in range(star + 1)):
            raise PqlError(Problem.MixedScopes, at, f"{star.label}:* cannot be combined with a group key at or above it")


def check_implicit_groups(plan: Plan, explicit_stars: bool, at: tuple[int, int]) -> None:
    """Aggregates group their scope; order keys of plain attributes there mean nothing and go."""
    for of_order in (False, True):
        expressions = [e for _, e, _ in plan.order_by] if of_order else [c.expression for c in plan.columns]
        scopes = {a.scope if a.prefix is None else a.argument.scope for e in expressions for a in aggregates(e)}
        for scope in sorted(s for s in scopes if not plan.keys_at(s)):
            plan.order_by = [o for o in plan.order_by if max((a.scope for a in attributes(o[1], into_aggregates=False)), default=None) != scope]
            if explicit_stars and any(star >= scope for star in plan.stars):
                raise PqlError(Problem.ExplicitSelectAllWithImplicitGroupBy, at, f"all attributes cannot be selected where {scope.label}s are grouped")
            loose = [a for e in expressions for a in attributes(e, into_aggregates=False) if a.scope == scope]
            if loose:
                raise PqlError(Problem.MissingAttributesInAggregation, loose[0].at, f"{loose[0].text} must be aggregated as {scope.label}s are grouped")


# -- planning -------------------------------------------------------------------------------


def compile_query(text: str, classifiers: Iterable[Classifier] = ()) -> Plan:
    """The logical plan of a query text; raises PqlError."""
    return plan_query(parse(text), Resolver(classifiers))


def plan_query(q: Query, resolver: Resolver) -> Plan:
    at = (1, 0)
    plan = Plan(stars=set(q.stars), limits=q.limits, offsets=q.offsets, delete=q.delete, implicit_all=q.implicit_all)
    if q.where is not None:
        used = resolver.uses(q.where)
        if used and q.delete is None:
            raise PqlError(Problem.ClassifierInWhere, used[0].at, f"classifier {used[0].name} cannot stand in where")
        plan.where = resolver.expression(q.where)
        check_where(plan.where)
    if q.delete is not None:
        if q.order_by or q.limits or q.offsets:
            raise PqlError(Problem.SyntaxError, at, "delete takes no order by, limit or offset: it would delete all that matches")
        return plan
    guards: list[Attribute] = []
    for e in [*q.group_by, *(e for e, _ in q.order_by)]:
        for c in resolver.uses(e):
            guards += [replace(resolver.key(c, k), scope=c.base) for k in c.keys]
    plan.group_by = [resolver.expression(n) for n in q.group_by]
    plan.columns = expand(q.columns, resolver)
    plan.order_by = [(scope_of(e), e, desc) for e, desc in ((resolver.expression(e), desc) for e, desc in q.order_by)]
    check_projected(plan)
    if not q.implicit_all:
        check_stars(plan, at)
    check_implicit_groups(plan, not q.implicit_all, at)
    if q.implicit_all:
        project_groups(plan)
    for g in dict.fromkeys(guards):
        condition = IsNull(g, True)
        plan.where = condition if plan.where is None else Binary("and", plan.where, condition)
    for n, c in enumerate(plan.columns):
        e = c.expression
        c.alias = f"{c.scope.letter}_{e.name.replace(':', '_')}" if isinstance(e, Attribute) else f"fn_{n}" if isinstance(e, (Call, Aggregate)) else f"col_{n}"
    seen: set[str] = set()
    plan.columns = [c for c in plan.columns if not (c.alias in seen or seen.add(c.alias))]
    return plan


def expand(columns: list, resolver: Resolver) -> list[Column]:
    """Resolved columns; a classifier of several keys becomes one column per key."""
    out = []
    for c in columns:
        e = resolver.expression(c)
        if isinstance(e, Attribute) and e.kind == "classifier":
            out += [Column(e.base, resolver.key(e, k), "") for k in e.keys]
        else:
            out.append(Column(scope_of(e), e, ""))
    return out


def project_groups(plan: Plan) -> None:
    """Without a select clause, groups show their keys and what lies above them."""
    scopes = [k.scope for k in plan.group_by] + [a.scope for _, e, _ in plan.order_by for a in aggregates(e)]
    if not scopes:
        return
    plan.stars = {s for s in plan.stars if s < min(scopes)}
    for k in plan.group_by:
        for key in k.keys or (k.name,):
            known = standard(k.base, key)
            kind = "standard" if known else "custom"
            plan.columns.append(Column(k.base, Attribute(known[0] if known else key, k.base, k.base, kind, known[1] if known else k.type, path=k.path), ""))
