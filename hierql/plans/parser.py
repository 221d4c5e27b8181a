"""Recursive-descent parser from tokens to an unresolved query."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from hierql.errors import PqlError, Problem
from hierql.functions.catalog import SCOPES, Scope, Type

from .ast import Aggregate, Binary, Call, In, IsNull, Literal, Match, Name, Not, Query
from .lexer import Token, tokens

_SCOPED = re.compile(r"(\^*)(?:(log|l|trace|t|event|e):)?(.*)", re.DOTALL)
_COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")


def split_scope(text: str) -> tuple[int, Scope | None, str]:
    """(number of hoists, scope, rest) of a prefixed text."""
    hoist, scope, rest = _SCOPED.fullmatch(text).groups()
    return len(hoist), SCOPES.get(scope), rest


def parse_datetime(text: str) -> datetime:
    """UTC instant of a datetime literal without its ``D``; no zone means UTC."""
    m = re.fullmatch(r"(\d{4})-?(\d\d)(?:-?(\d\d))?(?:T?(\d\d):?(\d\d)(?::?(\d\d))?(?:\.(\d{3}))?)?(Z|[+-]\d\d(?::?\d\d)?)?", text)
    year, month, day, hour, minute, second, milli, zone = m.groups()
    moment = datetime(int(year), int(month), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), int(milli or 0) * 1000, UTC)
    if zone and zone != "Z":
        digits = zone[1:].replace(":", "").ljust(4, "0")
        shift = (int(digits[:2]) * 60 + int(digits[2:])) * (1 if zone[0] == "+" else -1)
        moment = datetime.fromtimestamp(moment.timestamp() - shift * 60, UTC)
    return moment


class Parser:
    def __init__(self, text: str):
        self.tokens, self.i = tokens(text), 0

    # -- tokens --

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def accept(self, *kinds: str) -> Token | None:
        if self.now.kind in kinds:
            self.i += 1
            return self.tokens[self.i - 1]
        return None

    def expect(self, *kinds: str) -> Token:
        found = self.accept(*kinds)
        if found is None:
            self.fail(f"expected {' or '.join(kinds)}, found {self.now.text or 'the end'!r}")
        return found

    def fail(self, text: str):
        raise PqlError(Problem.SyntaxError, self.now.at, text)

    def listed(self, item) -> list:
        out = [item()]
        while self.accept(","):
            out.append(item())
        return out

    # -- clauses --

    def query(self) -> Query:
        q = Query()
        if self.accept("delete"):
            found = self.accept("scope")
            q.delete = SCOPES[found.text] if found else Scope.EVENT
        elif self.accept("select"):
            self.select(q)
        else:
            q.stars = list(Scope)
        if self.accept("where"):
            q.where = self.logic()
        if q.delete is None and self.accept("group by"):
            q.group_by = self.listed(lambda: self.name(self.expect("id")))
        if self.accept("order by"):
            q.order_by = self.listed(self.ordered)
        if self.accept("limit"):
            q.limits = self.windows(least=1)
        if self.accept("offset"):
            q.offsets = self.windows(least=1)
        self.expect("end")
        return q

    def select(self, q: Query) -> None:
        q.implicit_all = False
        if self.accept("*"):
            q.stars = list(Scope)
            if not self.accept(","):
                return
        while True:
            star = self.now.kind == "scope" and [t.kind for t in self.tokens[self.i + 1 : self.i + 3]] == [":", "*"]
            if star:
                scope = SCOPES[self.now.text]
                self.i += 3
                if scope not in q.stars:
                    q.stars.append(scope)
            else:
                q.columns.append(self.arithmetic())
            if not self.accept(","):
                return

    def ordered(self):
        e = self.arithmetic()
        direction = self.accept("asc", "desc")
        return e, direction is not None and direction.kind == "desc"

    def windows(self, least: int) -> dict[Scope, int]:
        out: dict[Scope, int] = {}
        for t in self.listed(lambda: self.expect("number")):
            _, scope, text = split_scope(t.text)
            n = round(float(text))
            if scope is None:
                raise PqlError(Problem.ScopeRequired, t.at, "a limit or offset needs a scope")
            if n < least:
                raise PqlError(Problem.PositiveIntegerRequired, t.at, f"{t.text} is not a positive integer")
            out[scope] = n
        return out

    # -- logic --

    def logic(self):
        left = self.conjunction()
        while t := self.accept("or"):
            left = Binary("or", left, self.conjunction(), t.at)
        return left

    def conjunction(self):
        left = self.negation()
        while t := self.accept("and"):
            left = Binary("and", left, self.negation(), t.at)
        return left

    def negation(self):
        return Not(self.negation()) if self.accept("not") else self.condition()

    def condition(self):
        """A comparison, or a parenthesised condition: which one shows only after the parenthesis."""
        start = self.i
        try:
            return self.comparison()
        except PqlError as first:
            if self.tokens[start].kind != "(":
                raise
            self.i = start + 1
            try:
                inner = self.logic()
                self.expect(")")
            except PqlError as second:
                raise max(first, second, key=lambda e: (e.line, e.position)) from None
            return inner

    def comparison(self):
        left = self.arithmetic()
        if t := self.accept(*_COMPARISONS):
            return Binary(t.kind, left, self.arithmetic(), t.at)
        if t := self.accept("is null", "is not null"):
            return IsNull(left, t.kind == "is not null")
        if t := self.accept("in", "not in"):
            self.expect("(")
            items = self.listed(lambda: self.name(self.accept("id")) if self.now.kind == "id" else self.literal())
            self.expect(")")
            return In(left, tuple(items), t.kind == "not in")
        if t := self.accept("like", "matches"):
            return Match(t.kind, left, split_scope(self.expect("string").text)[2][1:-1])
        return self.fail(f"expected a comparison, found {self.now.text or 'the end'!r}")

    # -- arithmetic --

    def arithmetic(self):
        left = self.product()
        while t := self.accept("+", "-"):
            left = Binary(t.kind, left, self.product(), t.at)
        return left

    def product(self):
        left = self.operand()
        while t := self.accept("*", "/"):
            left = Binary(t.kind, left, self.operand(), t.at)
        return left

    def operand(self):
        if self.accept("("):
            inner = self.arithmetic()
            self.expect(")")
            return inner
        if t := self.accept("now", "function", "aggregate"):
            _, scope, function = split_scope(t.text)
            self.expect("(")
            argument = None
            if t.kind == "aggregate":
                argument = self.name(self.expect("id"))
            elif t.kind == "function":
                argument = self.arithmetic()
            self.expect(")")
            return (Aggregate if t.kind == "aggregate" else Call)(function, scope, argument, t.at)
        if t := self.accept("id"):
            return self.name(t)
        return self.literal()

    def name(self, t: Token) -> Name:
        bracketed = t.text.startswith("[")
        hoist, scope, name = split_scope(t.text[1:-1] if bracketed else t.text)
        return Name(name, scope, hoist, bracketed, t.at)

    def literal(self) -> Literal:
        t = self.expect("string", "number", "boolean", "datetime", "uuid", "null")
        _, scope, text = split_scope(t.text)
        if t.kind == "string":
            return Literal(text[1:-1], Type.STRING, scope, t.at)
        if t.kind == "number":
            return Literal(float(text), Type.NUMBER, scope, t.at)
        if t.kind == "boolean":
            return Literal(text == "true", Type.BOOLEAN, scope, t.at)
        if t.kind == "uuid":
            return Literal(text.lower(), Type.ID, scope, t.at)
        if t.kind == "null":
            return Literal(None, Type.NULL, scope, t.at)
        try:
            return Literal(parse_datetime(text[1:]), Type.DATETIME, scope, t.at)
        except ValueError as e:
            raise PqlError(Problem.InvalidDateTime, t.at, f"{t.text}: {e}") from None


def parse(text: str) -> Query:
    return Parser(text).query()
