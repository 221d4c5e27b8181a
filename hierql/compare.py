"""Comparing results as XES JSON: equal, equal up to an order that the query leaves open, or different.

Two documents are equal if their logs, traces and events are, in order: single
items and lists of one are the same, numbers agree within a tolerance, and the
values of identities are not looked at.  Where a query groups or does not order, the
order of the groups is open, and a window may cut among equals.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

LEVELS = ("trace", "event")


class Match(Enum):
    EQUAL = "equal"
    REORDERED = "equal in another order"
    CUT_AMONG_EQUALS = "a window of the same rows"
    DIFFERENT = "different"


@dataclass
class Comparison:
    match: Match
    differences: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return self.match is not Match.DIFFERENT


def listed(value: Any) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def number(text: Any) -> Any:
    """A number rounded to nine digits, which is the tolerance, other values as they are."""
    try:
        return f"{float(text):.9g}"
    except (TypeError, ValueError):
        return text


def attributes(item: dict | None) -> tuple:
    """A component's attributes by tag and key, in order; an identity counts by its key alone."""
    found = []
    for tag, values in (item or {}).items():
        if tag.startswith("@") or tag in (*LEVELS, "extension", "global", "classifier"):
            continue
        for v in listed(values):
            key = v.get("@key")
            value = None if tag == "id" or key == "identity:id" else v.get("@value")
            found.append(("number", key, number(value)) if tag in ("int", "float") else (tag, key, value))
    return tuple(sorted(found, key=repr))


def shape(item: dict | None, ordered: bool) -> tuple:
    """A component with all below it; children in order, or in a canonical one."""
    children = []
    for level in LEVELS:
        inner = [shape(x, ordered) for x in (listed(item[level]) if isinstance(item, dict) and item.get(level) is not None else [])]
        children.append(tuple(inner if ordered else sorted(inner, key=repr)))
    return attributes(item), tuple(children)


def compare(one: list[dict], other: list[dict], order_is_open: bool = False, window_is_open: bool = False) -> Comparison:
    """Compare lists of documents {"log": ...}.

    ``order_is_open`` accepts another order of logs, traces and events,
    ``window_is_open`` also one side's traces being some of the other's.
    """
    sides = [[d.get("log", d) for d in x] for x in (one, other)]
    if [shape(x, True) for x in sides[0]] == [shape(x, True) for x in sides[1]]:
        return Comparison(Match.EQUAL)
    if order_is_open:
        counted = [Counter(shape(x, False) for x in side) for side in sides]
        if counted[0] == counted[1]:
            return Comparison(Match.REORDERED)
    if window_is_open and len(sides[0]) == len(sides[1]):
        if all(subset(a, b, not order_is_open) or subset(b, a, not order_is_open) for a, b in zip(*sides, strict=True)):
            return Comparison(Match.CUT_AMONG_EQUALS)
    return Comparison(Match.DIFFERENT, describe(*sides))


def subset(small: dict, large: dict, ordered: bool) -> bool:
    """Whether two logs agree in their attributes, and one's traces are some of the other's."""
    traces = [Counter(shape(t, ordered) for t in listed(x.get("trace"))) for x in (small, large)]
    return attributes(small) == attributes(large) and not traces[0] - traces[1]


def describe(one: list[dict], other: list[dict], most: int = 20) -> list[str]:
    """The first differences, by place."""
    out: list[str] = []

    def walk(a: Any, b: Any, place: str) -> None:
        if len(out) >= most:
            return
        x, y = attributes(a), attributes(b)
        for only, side in ((set(x) - set(y), "first"), (set(y) - set(x), "second")):
            out.extend(f"{place}: only the {side} has {v}" for v in sorted(only, key=repr))
        for level in LEVELS:
            left, right = (listed(i.get(level)) if isinstance(i, dict) else [] for i in (a, b))
            if len(left) != len(right):
                out.append(f"{place}: {len(left)} and {len(right)} {level}s")
            for i, (m, n) in enumerate(zip(left, right, strict=False)):
                walk(m, n, f"{place}/{level} {i + 1}")

    if len(one) != len(other):
        out.append(f"{len(one)} and {len(other)} logs")
    for i, (a, b) in enumerate(zip(one, other, strict=False)):
        walk(a, b, f"log {i + 1}")
    return out[:most]
