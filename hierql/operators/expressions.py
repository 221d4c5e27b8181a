"""Expressions as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from hierql.functions.catalog import Type
from hierql.plans.ast import Aggregate, Attribute, Binary, Call, In, IsNull, Literal, Match, Not
from hierql.plans.compiler import type_of

NUMERIC = (Type.NUMBER, Type.INTEGER)
_DATE_PARTS = ("year", "month", "day", "hour", "minute", "second", "quarter", "dayofweek")


@dataclass(frozen=True)
class Bound:
    """An attribute's column in the level frames."""

    attribute: Attribute
    column: str
    type: Type


def wanted(other: Any) -> Type | None:
    """The type that an operand asks of an untyped one beside it."""
    kind = type_of(other)
    return None if kind in (Type.UNKNOWN, Type.NULL) else Type.STRING if kind in (Type.ID, Type.TIME) else kind


def bind(e: Any, place: Callable[[Attribute, Type | None], Bound], want: Type | None = None) -> Any:
    """The expression with attributes bound to columns of the types that their surroundings ask for."""
    if isinstance(e, Attribute):
        return place(e, want)
    if isinstance(e, Binary):
        if e.op in ("and", "or"):
            return Binary(e.op, bind(e.left, place), bind(e.right, place))
        if e.op in "-*/":
            pair = {type_of(e.left), type_of(e.right)}
            kind = Type.DATETIME if e.op == "-" and pair == {Type.DATETIME, Type.UNKNOWN} else Type.NUMBER
            return Binary(e.op, bind(e.left, place, kind), bind(e.right, place, kind))
        if any(isinstance(x, Attribute) and x.path for x in (e.left, e.right)):
            return Binary(e.op, bind(e.left, place, Type.STRING), bind(e.right, place, Type.STRING))
        return Binary(e.op, bind(e.left, place, wanted(e.right) or want), bind(e.right, place, wanted(e.left) or want))
    if isinstance(e, Not):
        return Not(bind(e.operand, place))
    if isinstance(e, IsNull):
        return IsNull(bind(e.operand, place), e.negated)
    if isinstance(e, In):
        kinds = [k for k in (wanted(i) for i in e.items) if k]
        return In(bind(e.operand, place, kinds[0] if kinds else None), tuple(bind(i, place, wanted(e.operand)) for i in e.items), e.negated)
    if isinstance(e, Match):
        return Match(e.op, bind(e.operand, place, Type.STRING), e.pattern)
    if isinstance(e, Call) and e.argument is not None:
        kind = Type.STRING if e.function in ("upper", "lower") else Type.NUMBER if e.function == "round" else Type.DATETIME
        return Call(e.function, e.scope, bind(e.argument, place, kind))
    if isinstance(e, Aggregate):
        kind = Type.NUMBER if e.function in ("sum", "avg") else want
        return Aggregate(e.function, e.prefix, bind(e.argument, place, kind))
    return e


def kind_of(e: Any) -> Type:
    """The type of a bound expression."""
    if isinstance(e, Bound):
        return e.type
    if isinstance(e, Aggregate):
        return Type.INTEGER if e.function == "count" else kind_of(e.argument) if e.function in ("min", "max") else Type.NUMBER
    if isinstance(e, Binary) and e.op in "+-*/":
        texts = {kind_of(e.left), kind_of(e.right)} & {Type.STRING, Type.ID, Type.TIME, Type.UNKNOWN}
        return Type.STRING if e.op == "+" and texts else Type.NUMBER
    return type_of(e)


def render(e: Any, aggregate: Callable[[Aggregate], Column], now: datetime) -> Column:
    """A bound expression as a column; three-valued logic is Spark's own."""

    def go(x: Any) -> Column:
        return render(x, aggregate, now)

    if isinstance(e, Bound):
        return F.col(e.column)
    if isinstance(e, Literal):
        return F.lit(e.value) if e.value is not None else F.lit(None).cast("double")
    if isinstance(e, Aggregate):
        return aggregate(e)
    if isinstance(e, Not):
        return ~go(e.operand)
    if isinstance(e, IsNull):
        return go(e.operand).isNotNull() if e.negated else go(e.operand).isNull()
    if isinstance(e, In):
        own, found = go(e.operand), None
        if all(isinstance(i, Literal) and i.value is not None for i in e.items):
            found = own.isin(*[F.lit(i.value) for i in e.items])
        else:
            for i in e.items:
                one = own == (go(i) if not isinstance(i, Literal) or i.value is not None else F.lit(None))
                found = one if found is None else found | one
        return ~found if e.negated else found
    if isinstance(e, Match):
        return like(go(e.operand), e.pattern) if e.op == "like" else go(e.operand).rlike("(?s)" + e.pattern)
    if isinstance(e, Call):
        return call(e.function, None if e.argument is None else go(e.argument), now)
    return binary(e, go(e.left), go(e.right))


def binary(e: Binary, a: Column, b: Column) -> Column:
    null = [isinstance(x, Literal) and x.value is None for x in (e.left, e.right)]
    if e.op == "and":
        return a & b
    if e.op == "or":
        return a | b
    if e.op in "+-*/":
        if kind_of(e) == Type.STRING:
            return F.concat(a.cast("string"), b.cast("string"))
        if e.op == "-" and kind_of(e.left) == kind_of(e.right) == Type.DATETIME:
            return F.floor((F.unix_micros(a) - F.unix_micros(b)) / 1e6) / 86400.0  # whole seconds, in days
        a, b = a.cast("double"), b.cast("double")
        return a + b if e.op == "+" else a - b if e.op == "-" else a * b if e.op == "*" else F.try_divide(a, b)
    if any(null):
        return F.lit(None).cast("boolean")
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]


def call(function: str, x: Column | None, now: datetime) -> Column:
    if function == "now":
        return F.lit(now)
    if function in _DATE_PARTS:
        return getattr(F, function)(x).cast("double")
    if function == "millisecond":
        return F.pmod(F.unix_millis(x), F.lit(1000)).cast("double")
    if function == "date":
        return F.to_date(x)
    if function == "time":
        return F.date_format(x, "HH:mm:ss.SSS")
    if function == "round":
        return F.floor(x + 0.5).cast("double")  # ties go up
    return F.upper(x) if function == "upper" else F.lower(x)


def like(x: Column, pattern: str) -> Column:
    """``%`` and ``_`` are wild; a backslash escapes only these two."""
    parts: list[str] = []  # literal texts and wildcards, wildcards as None-like marks
    for escaped, wild, text in re.findall(r"\\([%_])|([%_])|(\\|[^\\%_]+)", pattern):
        if wild:
            parts.append("\0" + wild)
        elif parts and parts[-1][0] != "\0":
            parts[-1] += escaped or text
        else:
            parts.append(escaped or text)
    shape = "".join(p[1] if p[0] == "\0" else "x" for p in parts)
    words = [p for p in parts if p[0] != "\0"]
    if shape in ("", "x"):
        return x == F.lit(words[0] if words else "")
    if re.fullmatch("%+", shape):
        return F.when(x.isNotNull(), True)
    if re.fullmatch("%*x%*", shape):
        test = x.contains if shape[0] == shape[-1] == "%" else x.startswith if shape[-1] == "%" else x.endswith
        return test(F.lit(words[0]))
    quoted = "".join({"\0%": ".*", "\0_": "."}.get(p, re.sub(r"([^\w\s])", r"\\\1", p)) for p in parts)
    return x.rlike(rf"(?s)\A{quoted}\z")
