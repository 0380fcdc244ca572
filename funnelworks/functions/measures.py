"""Aggregates that can be taken from rows or from a rollup of them.

A report names its aggregates through :class:`Measures`: from rows they are
plain SQL aggregates; from a :class:`Rollup` the same report adds up stored
counts and exact sums.  Both give the same values bit for bit, as every sum is
exact and every mean is one division at the end.
"""

from __future__ import annotations

import re

from funnelworks.functions.columns import count_where_sql, exact_avg_sql


class Measures:
    """Aggregates over the rows themselves."""

    def rows(self) -> str:
        return "count(1)"

    def where(self, predicate: str) -> str:
        return count_where_sql(predicate)

    def total(self, value: str) -> str:
        return f"sum({value})"

    def mean(self, value: str) -> str:
        return exact_avg_sql(value)


class Rollup(Measures):
    """The same aggregates over a rollup's rows.  ``parts``: the stored
    columns asked for so far, and the aggregate over the rows behind each."""

    def __init__(self) -> None:
        self.parts: dict[str, str] = {}

    def _part(self, kind: str, value: str, sql: str) -> str:
        name = f"{kind}_{re.sub(r'[^A-Za-z0-9]+', '_', value).strip('_').lower()}".rstrip("_")
        if self.parts.setdefault(name, sql) != sql:
            raise ValueError(f"two aggregates named {name}")
        return f"sum({name})"

    def rows(self) -> str:
        return self._part("rows", "", "count(1)")

    def where(self, predicate: str) -> str:
        return self._part("rows", predicate, count_where_sql(predicate))

    def total(self, value: str) -> str:
        return self._part("sum", value, f"sum({value})")

    def mean(self, value: str) -> str:
        total, n = self.total(value), self._part("count", value, f"count({value})")
        return f"CASE WHEN {n} > 0 THEN CAST({total} AS DOUBLE) / {n} END"


FROM_ROWS = Measures()
