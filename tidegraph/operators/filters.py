"""Search filters as Columns; a null comparison does not match."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = {"=": operator.eq, "<>": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def compare(column: Column, op: str, value: Any = None) -> Column:
    if op == "IS NULL":
        return column.isNull()
    if op == "IS NOT NULL":
        return column.isNotNull()
    return OPS[op](column, F.lit(value))


def any_of_all(column: str, groups: list[list[tuple]]) -> Column:
    """An OR of ANDs of (operator, value) over one time column."""
    return reduce(operator.or_, [reduce(operator.and_, [compare(F.col(column), *t) for t in g]) for g in groups])


def labelled(labels: Column | str, wanted: list[str], match: str = "any") -> Column:
    want = F.array(*map(F.lit, wanted))
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.arrays_overlap(c, want) if match == "any" else F.size(F.array_except(want, c)) == 0


@dataclass(frozen=True)
class SearchFilters:
    node_labels: list[str] | None = None
    label_match: str = "any"
    edge_types: list[str] | None = None
    edge_uuids: list[str] | None = None  # an empty list matches nothing
    dates: dict[str, list[list[tuple]]] = field(default_factory=dict)
    properties: list[tuple[str, str, Any]] = field(default_factory=list)
    overlaps: dict[str, list[str]] = field(default_factory=dict)
    excludes: dict[str, list[str]] = field(default_factory=dict)
    group_ids: list[str] | None = None  # none, [] and [''] mean all groups

    def edge(self) -> Column:
        """The condition for entity_edge rows (labels of the endpoints are joined by the caller)."""
        parts = self._common()
        if self.edge_types is not None:
            parts.append(F.col("name").isin(self.edge_types))
        if self.edge_uuids is not None:
            parts.append(F.col("uuid").isin(self.edge_uuids) if self.edge_uuids else F.lit(False))
        return reduce(operator.and_, parts, F.lit(True))

    def node(self) -> Column:
        parts = self._common()
        if self.node_labels:
            parts.append(labelled("labels", self.node_labels, self.label_match))
        return reduce(operator.and_, parts, F.lit(True))

    def _common(self) -> list[Column]:
        parts = [any_of_all(c, g) for c, g in self.dates.items() if g]
        if self.group_ids and self.group_ids != [""]:
            parts.append(F.col("group_id").isin(self.group_ids))
        for key, op, value in self.properties:
            parts.append(compare(F.col("attributes")[key], op, value))
        parts += [F.arrays_overlap(F.col(c), F.array(*map(F.lit, v))) for c, v in self.overlaps.items() if v]
        parts += [~F.coalesce(F.arrays_overlap(F.col(c), F.array(*map(F.lit, v))), F.lit(False)) for c, v in self.excludes.items() if v]
        return parts
