"""Deletion: components that match a condition, with all below them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hierql.functions.catalog import Scope
from hierql.model import IDS, EventStore
from hierql.operators.lowering import Lowering
from hierql.plans.compiler import Plan, compile_query


def without(store: EventStore, query: str) -> tuple[EventStore, EventStore]:
    """(what a delete query leaves, what it deletes), both lazy.

    Parents stay, even if nothing is left below them.  Writing what is left in
    one piece makes the deletion atomic.
    """
    plan = compile_query(query, store.classifiers)
    if plan.delete is None:
        raise ValueError("not a delete query")
    on = IDS[plan.delete]
    from hierql.engine import utc

    with utc(store.logs.sparkSession):
        gone = Lowering(store, Plan(where=plan.where)).members[plan.delete].select(*on)
    kept, dropped = dict(store.levels), {}
    for scope in Scope:
        if scope >= plan.delete:
            kept[scope] = store.levels[scope].join(gone, on, "left_anti")
            dropped[scope] = store.levels[scope].join(gone, on, "left_semi")
    return replace(store, levels=kept), replace(store, levels=dropped)


def delete(store: EventStore, query: str) -> tuple[EventStore, dict[Scope, int]]:
    """(store without the matching components, number of components deleted per scope)."""
    kept, dropped = without(store, query)
    return kept, {scope: rows.agg(F.count(F.lit(1))).first()[0] for scope, rows in dropped.levels.items()}
