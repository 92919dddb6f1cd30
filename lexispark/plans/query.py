"""Queries as immutable values."""

from __future__ import annotations

from dataclasses import dataclass

MUST, SHOULD, MUST_NOT = "MUST", "SHOULD", "MUST_NOT"


class Query:
    """Any of the classes below."""


@dataclass(frozen=True)
class TermQuery(Query):
    """One term of one field, as it stands: not analysed, case and all."""

    field: str
    term: str


@dataclass(frozen=True)
class StringQuery(Query):
    """A text that is analysed; documents with all its terms or, if there are none, with any of them."""

    field: str
    text: str


@dataclass(frozen=True)
class NumericRangeQuery(Query):
    """Documents whose number lies between both bounds, bounds included."""

    field: str
    lower: float
    upper: float


class BooleanQuery(Query):
    """All (MUST) or any (SHOULD) of its clauses, none of the MUST_NOT ones (an extension)."""

    def __init__(self, occur: str, *queries: Query, must_not: tuple[Query, ...] = ()):
        if occur not in (MUST, SHOULD):
            raise ValueError(f"occur must be {MUST} or {SHOULD}")
        self.occur, self.queries, self.must_not = occur, tuple(queries), tuple(must_not)
