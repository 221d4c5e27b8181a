"""Expressions and plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from hierql.functions.catalog import Scope, Type

Place = tuple[int, int]


@dataclass(frozen=True)
class Name:
    """An attribute as written."""

    name: str
    scope: Scope | None
    hoist: int
    bracketed: bool
    at: Place = (1, 0)


@dataclass(frozen=True)
class Attribute:
    """A resolved attribute: at home in ``base``, evaluated at ``scope``."""

    name: str
    base: Scope
    scope: Scope
    kind: str  # standard, system, custom or classifier
    type: Type
    keys: tuple[str, ...] = ()
    path: tuple[str, ...] = ()
    at: Place = field(default=(1, 0), compare=False)

    @property
    def hoisted(self) -> bool:
        return self.base != self.scope

    @property
    def text(self) -> str:
        body = f"{'^' * (self.base - self.scope)}{self.base.label}:{self.name}"
        return f"[{body}]" if self.kind == "custom" else body


@dataclass(frozen=True)
class Literal:
    value: Any
    type: Type
    scope: Scope | None = None
    at: Place = field(default=(1, 0), compare=False)

    @property
    def text(self) -> str:
        v = self.value
        if self.type == Type.STRING:
            shown = f"'{v}'"
        elif v is None:
            shown = "null"
        elif isinstance(v, bool):
            shown = str(v).lower()
        elif isinstance(v, datetime):
            shown = "D" + v.strftime("%Y-%m-%dT%H:%M:%S") + (f".{v.microsecond // 1000:03d}" if v.microsecond else "") + "Z"
        else:
            shown = str(v)
        return f"{self.scope.label}:{shown}" if self.scope is not None else shown


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any
    at: Place = field(default=(1, 0), compare=False)

    @property
    def text(self) -> str:
        def side(x):
            return f"({x.text})" if isinstance(x, Binary) and self.op in "*/" and x.op in "+-" else x.text

        return f"{side(self.left)} {self.op} {side(self.right)}"


@dataclass(frozen=True)
class Not:
    operand: Any

    @property
    def text(self) -> str:
        return f"not({self.operand.text})"


@dataclass(frozen=True)
class IsNull:
    operand: Any
    negated: bool

    @property
    def text(self) -> str:
        return f"{self.operand.text} is {'not ' * self.negated}null"


@dataclass(frozen=True)
class In:
    operand: Any
    items: tuple
    negated: bool

    @property
    def text(self) -> str:
        return f"{self.operand.text} {'not ' * self.negated}in ({', '.join(i.text for i in self.items)})"


@dataclass(frozen=True)
class Match:
    """``like`` or ``matches`` with a literal pattern."""

    op: str
    operand: Any
    pattern: str

    @property
    def text(self) -> str:
        return f"{self.operand.text} {self.op} '{self.pattern}'"


@dataclass(frozen=True)
class Call:
    function: str
    scope: Scope | None
    argument: Any  # None for now()
    at: Place = field(default=(1, 0), compare=False)

    @property
    def text(self) -> str:
        return f"{self.scope.label + ':' if self.scope is not None else ''}{self.function}({self.argument.text if self.argument is not None else ''})"


@dataclass(frozen=True)
class Aggregate:
    function: str
    prefix: Scope | None
    argument: Any
    at: Place = field(default=(1, 0), compare=False)

    @property
    def scope(self) -> Scope:
        return self.prefix if self.prefix is not None else self.argument.scope

    @property
    def text(self) -> str:
        return f"{self.prefix.label + ':' if self.prefix is not None else ''}{self.function}({self.argument.text})"


def children(e: Any) -> tuple:
    if isinstance(e, Binary):
        return (e.left, e.right)
    if isinstance(e, (Not, IsNull, Match)):
        return (e.operand,)
    if isinstance(e, In):
        return (e.operand, *e.items)
    if isinstance(e, (Call, Aggregate)):
        return (e.argument,) if e.argument is not None else ()
    return ()


def walk(e: Any, into_aggregates: bool = True):
    yield e
    if into_aggregates or not isinstance(e, Aggregate):
        for c in children(e):
            yield from walk(c, into_aggregates)


def attributes(e: Any, into_aggregates: bool = True) -> list[Attribute]:
    return [x for x in walk(e, into_aggregates) if isinstance(x, Attribute)]


def aggregates(e: Any) -> list[Aggregate]:
    return [x for x in walk(e) if isinstance(x, Aggregate)]


def rebuild(e: Any, change) -> Any:
    """The expression with every node passed through ``change``, leaves first."""
    if isinstance(e, Binary):
        e = replace(e, left=rebuild(e.left, change), right=rebuild(e.right, change))
    elif isinstance(e, (Not, IsNull, Match)):
        e = replace(e, operand=rebuild(e.operand, change))
    elif isinstance(e, In):
        e = replace(e, operand=rebuild(e.operand, change), items=tuple(rebuild(i, change) for i in e.items))
    elif isinstance(e, (Call, Aggregate)) and e.argument is not None:
        e = replace(e, argument=rebuild(e.argument, change))
    return change(e)


@dataclass
class Query:
    """A parsed query; expressions are unresolved until resolution."""

    delete: Scope | None = None
    implicit_all: bool = True
    stars: list[Scope] = field(default_factory=list)
    columns: list = field(default_factory=list)
    where: Any = None
    group_by: list = field(default_factory=list)
    order_by: list[tuple[Any, bool]] = field(default_factory=list)  # expression, descending
    limits: dict[Scope, int] = field(default_factory=dict)
    offsets: dict[Scope, int] = field(default_factory=dict)
