"""From a logical plan to one DataFrame per level.

A query is lowered in the order: bind attributes to columns of narrow level
frames, find the members of each level (where), form groups, aggregate, order
and window, project.  Levels stay apart, one row per component, so nothing is
counted on an exploded join; hoisted conditions are semi-joins; and everything is lazy,
so a level that a caller does not use costs nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hierql.functions.catalog import Scope, Type, standard
from hierql.model import IDS, ORDERS, EventStore
from hierql.plans.ast import Aggregate, Attribute, In, Literal, rebuild, walk
from hierql.plans.compiler import Plan

from .expressions import Bound, bind, render

LOG, TRACE, EVENT = Scope.LOG, Scope.TRACE, Scope.EVENT


def ordering(column: Column, descending: bool) -> Column:
    """Null is the largest value."""
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def bounds(expression: Any) -> list[Bound]:
    return [x for x in walk(expression) if isinstance(x, Bound)]


@dataclass
class LevelResult:
    """A level's rows: ids, ``_pos`` (order within the parent) and the projected columns."""

    frame: DataFrame
    names: dict[str, str]  # column -> canonical text


class Lowering:
    def __init__(self, store: EventStore, plan: Plan, now: datetime | None = None):
        self.store, self.plan, self.now = store, plan, now or datetime.now(UTC)
        self.places: dict[tuple, Bound] = {}
        place = self.place
        self.where = bind(plan.where, place) if plan.where is not None else None
        self.columns = [(c, bind(c.expression, place)) for c in plan.columns]
        self.order_by = [(s, bind(e, place), desc) for s, e, desc in plan.order_by]
        self.keys = [(k, [place(p, None) for p in self.parts(k)]) for k in plan.group_by]
        self.base = {s: self.level(s) for s in Scope}
        self.members = self.find_members()
        self.kinds = self.group_kinds()
        self.counted: str | None = None  # column of map(TRACE) with the number of a trace's member events, if it has one
        self.maps: dict[Scope, DataFrame] = {}

    # -- binding --

    def place(self, a: Attribute, want: Type | None) -> Bound:
        kind = a.type if a.kind != "custom" else want or Type.UNKNOWN
        key = (a.base, a.kind, a.name, kind)
        if key not in self.places:
            self.places[key] = Bound(a, f"x{len(self.places)}", kind)
        known = self.places[key]
        return Bound(a, known.column, kind)

    def parts(self, key: Attribute) -> list[Attribute]:
        """The attributes that a group key compares: itself, or those of its classifier."""
        if key.kind != "classifier":
            return [key]
        out = []
        for name in key.keys:
            known = standard(key.base, name)
            out.append(Attribute(known[0] if known else name, key.base, key.scope, "standard" if known else "custom", known[1] if known else Type.UNKNOWN))
        return out

    def level(self, scope: Scope) -> DataFrame:
        """Ids, order and the attributes that the query uses, no others."""
        frame, binding = self.store.levels[scope], self.store.bindings[scope]
        own = [(b, key) for key, b in self.places.items() if key[0] == scope]
        stars = []
        if scope in self.plan.stars:
            stars = [c.alias(n) for n, c in binding.all_columns(scope, frame)]
        return frame.select(*IDS[scope], ORDERS[scope], *[binding.column(frame, b.attribute, None if key[3] == Type.UNKNOWN else key[3]).alias(b.column) for b, key in own], *stars)

    def with_parents(self, frame: DataFrame, scope: Scope, expression: Any, hoisted: bool | None = None) -> DataFrame:
        """A level's rows with the parents' columns that an expression uses."""
        for parent in (TRACE, LOG):
            needed = sorted({b.column for b in bounds(expression) if b.attribute.base == parent and (hoisted is None or b.attribute.hoisted == hoisted)})
            needed = [c for c in needed if c not in frame.columns]
            if parent < scope and needed:
                frame = frame.join(self.base[parent].select(*IDS[parent], *needed), IDS[parent])
        return frame

    # -- members --

    def find_members(self) -> dict[Scope, DataFrame]:
        """Per level the rows that satisfy where.

        The condition is evaluated at the deepest scope of its attributes and
        decides there; rows above stay if they have a row that stays, rows below
        stay with their parent.  Hoisted attributes are existential: they all
        read one component below, any of those in their widest scope.
        """
        base = self.base
        if self.where is None:
            return dict(base)
        used = bounds(self.where)
        scope = max((b.attribute.scope for b in used), default=LOG)
        hoisted = [b for b in used if b.attribute.hoisted]
        left = base[scope]
        if hoisted:
            anchor = min(b.attribute.scope for b in hoisted)
            deepest = max(b.attribute.base for b in hoisted)
            right = self.with_parents(base[deepest], deepest, self.where, hoisted=True)
            rename = {b.column: f"h{b.column}" for b in hoisted}
            condition = rebuild_bound(self.where, lambda b: Bound(b.attribute, rename[b.column], b.type) if b.attribute.hoisted else b)
            right = right.select(*[F.col(c).alias(f"h_{c}") for c in IDS[anchor]], *[F.col(c).alias(n) for c, n in rename.items()])
            plain = [b for b in used if not b.attribute.hoisted]
            left = self.with_parents(left, scope, self.where, hoisted=False) if plain else left
            on = self.render(condition)
            for c in IDS[anchor]:
                on = (F.col(c) == F.col(f"h_{c}")) & on
            kept = left.join(right, on, "left_semi")
        else:
            kept = self.with_parents(left, scope, self.where).where(self.render(self.where))
        kept = kept.select(*base[scope].columns)
        found = {scope: kept}
        for below in range(scope + 1, EVENT + 1):
            found[Scope(below)] = base[Scope(below)].join(kept.select(*IDS[scope]), IDS[scope], "left_semi")
        for above in range(scope - 1, -1, -1):
            ids = IDS[Scope(above)]
            found[Scope(above)] = base[Scope(above)].join(kept.select(*ids).distinct(), ids, "left_semi")
        return found

    def render(self, expression: Any, aggregate=None) -> Column:
        return render(expression, aggregate, self.now)

    # -- groups --

    def group_kinds(self) -> dict[Scope, str]:
        """Per level: keys, all (one group), position (children of merged parents) or each."""
        kinds, merged = {}, False
        scopes = {a.scope for a in self.plan.aggregates()}
        for s in Scope:
            kinds[s] = "keys" if self.plan.keys_at(s) else "all" if s in scopes else "position" if merged else "each"
            merged = merged or kinds[s] != "each"
        return kinds

    GROUPS = {LOG: ["lg"], TRACE: ["lg", "tg"], EVENT: ["lg", "tg", "eg"]}

    def map(self, scope: Scope) -> DataFrame:
        """Member rows of a level with the groups of their parents and their own."""
        if scope not in self.maps:
            self.maps[scope] = self.make_map(scope)
        return self.maps[scope]

    def make_map(self, scope: Scope) -> DataFrame:
        rows, kind, own = self.members[scope], self.kinds[scope], self.GROUPS[scope][-1]
        above = [Scope(s) for s in range(scope)]
        orders = [ORDERS[s] for s in above]
        if any(self.kinds[s] != "each" for s in above):
            parent = above[-1]
            rows = rows.join(self.map(parent).select(*IDS[parent], *self.GROUPS[parent], *orders), IDS[parent])
        else:
            rows = rows.select("*", *[F.col(IDS[s][-1]).cast("string").alias(self.GROUPS[s][-1]) for s in above], *[F.lit(0).cast("long").alias(o) for o in orders])
        if kind == "each":
            return rows.withColumn(own, F.col(IDS[scope][-1]).cast("string"))
        if kind == "all":
            return rows.withColumn(own, F.lit("all"))
        if kind == "position":
            keys = [ordering(self.render(e), desc) for s, e, desc in self.order_by if s == scope and not has_aggregate(e) and all(b.attribute.base == scope for b in bounds(e))]
            position = F.row_number().over(W.partitionBy(*IDS[scope][:-1]).orderBy(*keys, ORDERS[scope]))
            rows = rows.withColumn("_place", position)
            if scope in self.plan.limits and not any(s == scope for s, _, _ in self.order_by):
                # Groups come in order of their places, so those beyond the window are not formed.
                rows = rows.where(F.col("_place") <= self.plan.offsets.get(scope, 0) + self.plan.limits[scope])
            return rows.withColumn(own, F.col("_place").cast("string")).drop("_place")
        values: list[Column] = []
        for n, (key, parts) in enumerate((k, p) for k, p in self.keys if k.scope == scope):
            if key.hoisted:
                rows, value = self.with_sequence(rows, scope, key, parts, f"seq{n}")
                values.append(value)
            elif key.kind == "classifier":
                values.append(F.concat(*[F.coalesce(F.col(p.column).cast("string"), F.lit("")) for p in parts]))
            else:
                rows = self.with_parents(rows, scope, parts[0])
                values.append(F.col(parts[0].column))
        return rows.withColumn(own, F.md5(F.concat(*[measured(v) for v in values]).cast("binary")))

    def with_sequence(self, rows: DataFrame, scope: Scope, key: Attribute, parts: list[Bound], name: str) -> tuple[DataFrame, Column]:
        """Rows with a digest of the sequence of a descendant attribute's values over their members.

        Values come in order of position, or sorted if the query orders by the
        same attribute.  Nulls stay in the sequence.  A row without descendants has an
        empty one; it goes if the query shows values of that level.

        A sequence is the set of its (position, value) pairs, a sorted one the
        multiset of its values, so its digest is an exclusive or of hashes: no
        sequence is ever put together, and a log's is added up from its traces.
        """
        ids, members = IDS[scope], self.members[key.base]
        value = F.concat_ws("\x1f", *[F.coalesce(F.col(p.column).cast("string"), F.lit("")) for p in parts]) if key.kind == "classifier" else F.col(parts[0].column)
        if any(isinstance(e, Bound) and e.attribute.base == key.base and e.attribute.name == key.name for _, e, _ in self.order_by):
            pairs = members.groupBy(*ids, value.alias("_v")).agg(F.count(F.lit(1)).alias("_p"))
            size = F.sum("_p")
        else:
            own = W.partitionBy(*IDS[key.base][:-1]).orderBy(ORDERS[key.base])
            pairs = members.select(*IDS[key.base][:-1], value.alias("_v"), F.row_number().over(own).cast("long").alias("_p"))
            size = F.count(F.lit(1))
            if key.base - scope == 2:
                counts = members.groupBy(*IDS[TRACE]).agg(F.count(F.lit(1)).alias("_n")).join(self.base[TRACE].select(*IDS[TRACE], "trace_order"), IDS[TRACE])
                before = F.sum("_n").over(W.partitionBy(*ids).orderBy("trace_order").rowsBetween(W.unboundedPreceding, -1))
                pairs = pairs.join(counts.select(*IDS[TRACE], F.coalesce(before, F.lit(0)).alias("_b")), IDS[TRACE]).withColumn("_p", F.col("_p") + F.col("_b"))
        hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "_p", F.col("_v").isNull(), "_v")).cast("string") for seed in (1, 2)]
        digests = pairs.groupBy(*ids).agg(size.alias(f"{name}_n"), F.concat_ws(":", size.cast("string"), *hashes).alias(name))
        shown = any(c.scope == key.base for c, _ in self.columns)
        if scope == TRACE and key.base == EVENT:
            self.counted = f"{name}_n"
        rows = rows.join(digests, ids, "inner" if shown else "left")
        return rows, F.coalesce(F.col(name), F.lit(""))

    # -- aggregates --

    def aggregate_rows(self, a: Aggregate, in_order: bool) -> tuple[tuple, Scope]:
        """((rows, population), scope): which rows an aggregate reads, and the scope that it groups at."""
        argument = a.argument.attribute
        rows = Scope(max(argument.base, a_scope(a)))
        whole = argument.hoisted and not in_order
        return (rows, whole), a_scope(a)

    def population(self, rows: Scope, whole: bool, scope: Scope, expression: Any) -> DataFrame:
        """Rows to aggregate, with the groups at ``scope``."""
        if rows == scope and not whole:
            return self.with_parents(self.map(scope), scope, expression)
        source = self.base[rows] if whole else self.members[rows]
        groups = self.map(scope).select(*IDS[scope], *self.GROUPS[scope])
        return self.with_parents(source, rows, expression).join(groups, IDS[scope])

    @staticmethod
    def aggregated(a: Aggregate) -> Column:
        x = F.col(a.argument.column)
        return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.function](x)

    # -- the rows of a level --

    def spine(self, scope: Scope, kept: DataFrame | None = None) -> tuple[DataFrame, dict, list[tuple[Column, bool]]]:
        """(groups of a level with everything to project or order by, aggregate columns, order keys).

        Only groups below the kept parents are formed: whole groups go, so
        aggregates still read all of their population.
        """
        groups, kind = self.GROUPS[scope], self.kinds[scope]
        rows = self.map(scope)
        shown = [e for c, e in self.columns if c.scope == scope]
        ordered = [(e, desc) for s, e, desc in self.order_by if s == scope]
        wanted: dict[tuple, list[tuple[Aggregate, str]]] = {}
        names: dict[tuple[Aggregate, bool], str] = {}
        for in_order, expressions in ((False, shown), (True, [e for e, _ in ordered])):
            for a in (a for e in expressions for a in aggregate_nodes(e)):
                (level, whole), at = self.aggregate_rows(a, in_order)
                if (a, in_order) not in names:
                    names[a, in_order] = f"agg{len(names)}"
                    wanted.setdefault((level, whole, at), []).append((a, names[a, in_order]))
        plain = [b for e in [*shown, *[e for e, _ in ordered]] for b in plain_bounds(e)]
        rows = self.with_parents(rows, scope, plain_tuple(plain))
        if kept is not None:
            rows = rows.join(kept, kept.columns, "left_semi")
        orders = [ORDERS[s] for s in Scope if s <= scope]
        stars = [c for c in self.base[scope].columns if c not in (*IDS[scope], ORDERS[scope]) and not c.startswith("x")] if scope in self.plan.stars else []
        merged = any(self.kinds[Scope(s)] != "each" for s in range(scope + 1))
        here = wanted.pop((scope, False, scope), []) if merged else []
        if merged:
            first = F.struct(*orders)
            columns = [F.min_by(c, first).alias(c) for c in dict.fromkeys([*(b.column for b in plain), *stars])]
            source = self.with_parents(rows, scope, plain_tuple([a.argument for a, _ in here]))
            counts = [F.count(F.lit(1)).alias("_count")]
            if scope == TRACE and self.counted:
                counts.append(F.coalesce(F.max(self.counted), F.lit(0)).alias("_events"))
            frame = source.groupBy(*groups).agg(F.min(first).alias("_first"), *counts, *columns, *[self.aggregated(a).alias(n) for a, n in here])
        else:
            frame = rows.select(*groups, F.struct(*orders).alias("_first"), F.lit(1).cast("long").alias("_count"), *dict.fromkeys([*(b.column for b in plain), *stars]))
        for (level, whole, at), found in wanted.items():
            source = self.population(level, whole, at, plain_tuple([a.argument for a, _ in found]))
            sums = source.groupBy(*self.GROUPS[at]).agg(*[self.aggregated(a).alias(n) for a, n in found])
            frame = frame.join(sums, self.GROUPS[at], "left")
        missing = [F.coalesce(F.col(n), F.lit(0)).alias(n) if a.function == "count" else F.col(n) for found in wanted.values() for a, n in found]
        if missing:
            other = [c for c in frame.columns if c not in {n for found in wanted.values() for _, n in found}]
            frame = frame.select(*other, *missing)
        keys = [(self.render(e, lambda a: F.col(names[a, True])), desc) for e, desc in ordered]
        return frame, names, keys

    def windowed(self, scope: Scope, frame: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
        """Rows within the level's limit and offset per parent, in the order of ``_pos``.

        They are numbered where the query orders or cuts them; else ``_pos`` is
        the order that they have anyway.
        """
        limit, offset = self.plan.limits.get(scope), self.plan.offsets.get(scope, 0)
        parents = self.GROUPS[scope][:-1]
        if limit is None and not offset and not keys:
            if self.kinds[scope] == "each":
                return frame.withColumn("_pos", F.col("_first")[ORDERS[scope]])
            if scope != EVENT:  # a log may have any number of groups: they are not numbered in one task
                return frame.withColumn("_pos", F.col("_first"))
        window = W.partitionBy(*parents) if parents else W.partitionBy()
        frame = frame.withColumn("_pos", F.row_number().over(window.orderBy(*[ordering(c, d) for c, d in keys], "_first", self.GROUPS[scope][-1])).cast("long"))
        if limit is not None:
            frame = frame.where(F.col("_pos") <= offset + limit)
        return frame.where(F.col("_pos") > offset) if offset else frame

    def log_keys(self) -> list[tuple[Scope, list]] | None:
        """The child level whose order ranks logs, if only logs' children are ordered and logs are cut."""
        if not (self.plan.limits.get(LOG) or self.plan.offsets.get(LOG)) or any(s == LOG for s, _, _ in self.order_by):
            return None
        return next((s for s in (TRACE, EVENT) if any(o == s for o, _, _ in self.order_by)), None)

    def results(self) -> dict[Scope, LevelResult]:
        out: dict[Scope, LevelResult] = {}
        kept: DataFrame | None = None
        ranking: tuple | None = None
        for scope in Scope:
            if ranking is not None and scope == ranking[0]:
                frame, names, keys = ranking[1]  # the same plan as in the logs' ranks, so Spark computes it once
                frame = frame.join(kept, kept.columns, "left_semi") if kept is not None else frame
            else:
                frame, names, keys = self.spine(scope, kept)
            if scope == LOG and (child := self.log_keys()) is not None:
                below = self.spine(child)
                if child == TRACE:
                    ranking = (child, below)
                child_keys = below[2]
                ranked = [c.alias(f"rank{i}") for i, (c, _) in enumerate(child_keys)]
                best = W.partitionBy("lg").orderBy(*[ordering(F.col(f"rank{i}"), d) for i, (_, d) in enumerate(child_keys)], "_first")
                first = below[0].select("lg", "_first", *ranked).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "_first")
                frame = frame.join(first, "lg", "left")
                keys = [(F.col(f"rank{i}"), d) for i, (_, d) in enumerate(child_keys)]
            frame = self.windowed(scope, frame, keys)
            if kept is not None or self.plan.limits.get(scope) or self.plan.offsets.get(scope):
                kept = frame.select(*self.GROUPS[scope])
            out[scope] = self.project(scope, frame, names)
        return out

    def project(self, scope: Scope, frame: DataFrame, names: dict) -> LevelResult:
        ids = [F.col(g).alias(n) for g, n in zip(self.GROUPS[scope], IDS[scope], strict=True)]
        texts: dict[str, str] = {}
        columns = []
        if scope in self.plan.stars:
            columns = [F.col(c) for c in frame.columns if c.startswith(f"{scope.letter}_")]
        have = {c for c in frame.columns if c.startswith(f"{scope.letter}_")} if columns else set()
        for c, e in self.columns:
            if c.scope == scope and c.alias not in have:
                columns.append(self.render(e, lambda a: F.col(names[a, False])).alias(c.alias))
                texts[c.alias] = c.text
        extra = [F.col("_count").alias("_trace_count")] if scope == TRACE else []
        if "_events" in frame.columns:
            extra.append(self.placeholders_of(F.col("_events")).alias("_null_event_count"))
        return LevelResult(frame.select(*ids, "_pos", *columns, *extra), texts)

    def shows(self, scope: Scope) -> bool:
        return scope in self.plan.stars or any(c.scope == scope for c, _ in self.columns)

    def placeholders_of(self, most: Column) -> Column:
        """How many empty events stand for those of a group whose longest trace has so many."""
        if self.shows(EVENT):
            return F.lit(0).cast("long")
        left = F.greatest(most - self.plan.offsets.get(EVENT, 0), F.lit(0))
        limit = self.plan.limits.get(EVENT)
        return (left if limit is None else F.least(left, F.lit(limit))).cast("long")

    def null_events(self, kept: DataFrame | None = None) -> DataFrame:
        """(log_id, trace_id, _null_event_count) of the trace groups, or of the ``kept`` ones.

        That is the number of events to show as empty ones where the query
        shows none: the most that a trace of the group has, windowed.
        """
        groups = self.map(TRACE).select(*IDS[TRACE], "lg", "tg")
        events = self.members[EVENT].select(*IDS[TRACE])
        if kept is not None:
            wanted = kept.select(F.col("log_id").alias("lg"), F.col("trace_id").alias("tg"))
            groups = groups.join(wanted, ["lg", "tg"], "left_semi")
            if not any(kind in ("keys", "all", "position") for kind in (self.kinds[LOG], self.kinds[TRACE])):
                events = events.join(kept.select(*IDS[TRACE]), IDS[TRACE], "left_semi")
            elif self.kinds[LOG] == "each":
                events = events.join(kept.select("log_id").distinct(), "log_id", "left_semi")
        counts = events.groupBy(*IDS[TRACE]).agg(F.count(F.lit(1)).alias("n"))
        most = groups.join(counts, IDS[TRACE], "left").groupBy("lg", "tg").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
        return most.select(F.col("lg").alias("log_id"), F.col("tg").alias("trace_id"), self.placeholders_of(F.col("n")).alias("_null_event_count"))


def measured(value: Column) -> Column:
    """A value's text with its length before it, so that texts of several values in a row are unambiguous."""
    text = value.cast("string")
    return F.when(value.isNull(), "n").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def a_scope(a: Aggregate) -> Scope:
    return a.prefix if a.prefix is not None else a.argument.attribute.scope


def has_aggregate(e: Any) -> bool:
    return bool(aggregate_nodes(e))


def aggregate_nodes(e: Any) -> list[Aggregate]:
    return [x for x in walk(e) if isinstance(x, Aggregate)]


def plain_bounds(e: Any) -> list[Bound]:
    return [x for x in walk(e, into_aggregates=False) if isinstance(x, Bound)]


def plain_tuple(items: list) -> Any:
    """An expression that holds others, for the functions that look for columns in one."""
    return In(Literal(None, Type.NULL), tuple(items), False)


def rebuild_bound(e: Any, change) -> Any:
    return rebuild(e, lambda x: change(x) if isinstance(x, Bound) else x)
