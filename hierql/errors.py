"""Compile-time problems of the query language."""

from __future__ import annotations

from enum import Enum

#: Names of problems, as clients see them.
PROBLEMS = """SyntaxError UnexpectedChild DuplicateLimit DuplicateOffset PositiveIntegerRequired DecimalPartDropped
ScopeRequired ScopeHoistingInSelectOrOrderBy NoHoistingBeyondLong UnknownAttributeType NoSuchAttribute MixedScopes
ExplicitSelectAllWithImplicitGroupBy MissingAttributesInAggregation SelectAllConflictsWithReferencingByName
AttributeNotInGroupBy OrderByClauseRemoved ClassifierInWhere ClassifierOnLog InvalidUseOfClassifiers
AggregationFunctionInWhere InvalidBoolean InvalidNumber InvalidDateTime InvalidUUID Unknown""".split()

Problem = Enum("Problem", {name: name for name in PROBLEMS})


class PqlError(Exception):
    """A query that cannot be compiled; line from 1, position from 0."""

    def __init__(self, problem: Problem, at: tuple[int, int], text: str):
        self.problem, self.line, self.position, self.text = problem, at[0], at[1], text
        super().__init__(f"Line {at[0]} position {at[1]}: {problem.value} — {text}")
