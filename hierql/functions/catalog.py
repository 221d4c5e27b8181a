"""Scopes, types, standard attributes and functions of the query language."""

from __future__ import annotations

from enum import Enum, IntEnum


class Scope(IntEnum):
    LOG = 0
    TRACE = 1
    EVENT = 2

    @property
    def label(self) -> str:
        return self.name.lower()

    @property
    def letter(self) -> str:
        return self.label[0]


SCOPES = {text: scope for scope in Scope for text in (scope.label, scope.letter)}


class Type(Enum):
    STRING = "string"
    NUMBER = "double"
    INTEGER = "bigint"
    DATETIME = "timestamp"
    DATE = "date"
    TIME = "string "
    BOOLEAN = "boolean"
    ID = "string  "
    NULL = "void"
    UNKNOWN = "unknown"

    @property
    def sql(self) -> str:
        return "string" if self in (Type.UNKNOWN, Type.NULL) else self.value.strip()


#: Fixed values: (shorthand, canonical name, type) per scope.
STANDARD = {
    Scope.LOG: [
        ("name", "concept:name", Type.STRING),
        ("id", "identity:id", Type.ID),
        ("model", "lifecycle:model", Type.STRING),
        ("version", "xes:version", Type.STRING),
        ("features", "xes:features", Type.STRING),
        ("db:id", "db:id", Type.NUMBER),
    ],
    Scope.TRACE: [
        ("name", "concept:name", Type.STRING),
        ("id", "identity:id", Type.ID),
        ("total", "cost:total", Type.NUMBER),
        ("currency", "cost:currency", Type.STRING),
    ],
    Scope.EVENT: [
        ("name", "concept:name", Type.STRING),
        ("instance", "concept:instance", Type.STRING),
        ("timestamp", "time:timestamp", Type.DATETIME),
        ("resource", "org:resource", Type.STRING),
        ("group", "org:group", Type.STRING),
        ("role", "org:role", Type.STRING),
        ("transition", "lifecycle:transition", Type.STRING),
        ("state", "lifecycle:state", Type.STRING),
        ("total", "cost:total", Type.NUMBER),
        ("currency", "cost:currency", Type.STRING),
        ("id", "identity:id", Type.ID),
    ],
}
#: The surrogate id of a log, reachable unbracketed only.
SYSTEM = {Scope.LOG: "logId"}
CLASSIFIER_PREFIXES = ("classifier:", "c:")

AGGREGATES = ("min", "max", "avg", "count", "sum")
SCALARS = {
    **dict.fromkeys(("year", "month", "day", "hour", "minute", "second", "millisecond", "quarter", "dayofweek", "round"), Type.NUMBER),
    "date": Type.DATE,
    "time": Type.TIME,
    "upper": Type.STRING,
    "lower": Type.STRING,
}


def standard(scope: Scope, name: str) -> tuple[str, Type] | None:
    """(canonical name, type) of a shorthand or canonical name."""
    return next(((canonical, kind) for short, canonical, kind in STANDARD[scope] if name in (short, canonical)), None)


def aggregate_type(function: str, argument: Type) -> Type:
    if function == "count":
        return Type.INTEGER
    return argument if function in ("min", "max") else Type.NUMBER
