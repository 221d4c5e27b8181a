"""Tokens: the longest match wins, of equally long ones the first rule."""

from __future__ import annotations

import re
from dataclasses import dataclass

from hierql.errors import PqlError, Problem
from hierql.functions.catalog import AGGREGATES, SCALARS

_GAP = r"[ \t\r\n]+"
_PREFIX = r"(?:(?:log|l):|\^?(?:trace|t):|\^{0,2}(?:event|e):|\^{0,2})"
_DAY, _MONTH, _MINUTE = r"(?:0[1-9]|[12]\d|30|31)", r"(?:0[1-9]|1[0-2])", r"[0-5]\d"
_HOUR, _ZONE = r"(?:[01]\d|2[0-3])", r"(?:Z|[+-](?:0\d|1[0-2])(?::?[0-5]\d)?)"
_WORD = r"[a-zA-Z\u0080-ÿ_0-9]+"
_INT = r"(?:0|[1-9]\d*)"


def _date(short: bool) -> str:
    if short:
        return rf"{_PREFIX}D\d{{4}}{_MONTH}{_DAY}(?:T?{_HOUR}{_MINUTE}(?:{_MINUTE}(?:\.\d{{3}})?)?{_ZONE}?)?"
    return rf"{_PREFIX}D\d{{4}}-{_MONTH}(?:-{_DAY})?(?:T{_HOUR}:{_MINUTE}(?::{_MINUTE}(?:\.\d{{3}})?)?{_ZONE}?)?"


def _function(names) -> str:
    return rf"{_PREFIX}(?:{'|'.join(sorted(names, key=len, reverse=True))})\("


_RULES = [
    (kind, re.compile(pattern, re.DOTALL))
    for kind, pattern in [
        *((w, w) for w in ("select", "delete", "where")),
        ("group by", rf"group{_GAP}by"),
        ("order by", rf"order{_GAP}by"),
        ("limit", "limit"),
        ("offset", "offset"),
        ("scope", "log|l|trace|t|event|e"),
        ("uuid", _PREFIX + r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
        ("string", _PREFIX + r"'(?:\\'|.)*?'"),
        ("string", _PREFIX + r'"(?:\\"|.)*?"'),
        ("number", _PREFIX + rf"-?{_INT}(?:\.\d+)?(?:[Ee][+-]?{_INT})?"),
        ("boolean", _PREFIX + "true|false"),
        ("datetime", _date(False)),
        ("datetime", _date(True)),
        ("null", _PREFIX + "null"),
        ("aggregate", _function(AGGREGATES)),
        ("function", _function(SCALARS)),
        ("now", _function(["now"])),
        *((op, re.escape(op)) for op in ("*", "/", "+", "-", "<", "<=", ">", ">=", "=", "!=")),
        ("is null", rf"is{_GAP}null"),
        ("is not null", rf"is{_GAP}not{_GAP}null"),
        ("in", "in"),
        ("not in", rf"not{_GAP}in"),
        *((w, w) for w in ("and", "or", "not", "matches", "like")),
        *((op, re.escape(op)) for op in "(),:"),
        ("asc", "asc"),
        ("desc", "desc"),
        ("id", rf"{_PREFIX}{_WORD}(?::{_WORD})?"),
        ("id", rf"\[{_PREFIX}.+?\]"),
        ("skip", r"(?://|--)[^\r\n]*"),
        ("skip", r"/\*.*?\*/"),
        ("skip", _GAP),
    ]
]


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: tuple[int, int]


def tokens(text: str) -> list[Token]:
    """All tokens of a query, ended by one of kind ``end``."""
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        best, kind = "", ""
        for name, rule in _RULES:
            m = rule.match(text, at)
            if m and len(m[0]) > len(best):
                best, kind = m[0], name
        if not best:
            raise PqlError(Problem.SyntaxError, (line, at - start), f"unexpected character {text[at]!r}")
        if kind in ("aggregate", "function", "now"):
            best = best[:-1]  # the parenthesis is a token of its own
        if kind != "skip":
            out.append(Token(kind, best, (line, at - start)))
        for m in re.finditer("\n", best):
            line, start = line + 1, at + m.end()
        at += len(best)
    return [*out, Token("end", "", (line, at - start))]
