"""The structured query: filters plus one operation."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from ..operators.grouping import AGGREGATES

LIST_FIELDS = ["brands", "sales_types", "months", "segments", "years", "model"]


def _as_list(value) -> list:
    """None -> empty, one text or number -> one element, else the elements."""
    if value is None:
        return []
    if isinstance(value, (str, int, float)):
        return [value]
    return list(value)


@dataclass(frozen=True)
class QuerySpec:
    """What to read, keep and compute. Empty lists keep everything."""

    operation: str = "query"
    intent: str = "general"
    language: str = "en"
    brands: list = field(default_factory=list)
    sales_types: list = field(default_factory=list)
    months: list = field(default_factory=list)
    segments: list = field(default_factory=list)
    years: list = field(default_factory=list)
    model: list = field(default_factory=list)
    technical_filters: dict = field(default_factory=dict)
    aggregation: str | None = "sum"
    chart_type: str | None = None
    analysis_type: str = "summary"

    def __post_init__(self):
        for name in LIST_FIELDS:
            object.__setattr__(self, name, _as_list(getattr(self, name)))
        object.__setattr__(self, "technical_filters", {
            k: _as_list(v) for k, v in (self.technical_filters or {}).items()
        })
        if not isinstance(self.aggregation, str) or not self.aggregation:
            object.__setattr__(self, "aggregation", "sum")
        if self.aggregation not in AGGREGATES:
            raise ValueError(
                f"unknown aggregation {self.aggregation!r}; one of {sorted(AGGREGATES)}")

    @classmethod
    def of(cls, query: QuerySpec | Mapping | str) -> QuerySpec:
        """From a spec, a mapping or a JSON object; fields it does not know are left out."""
        if isinstance(query, QuerySpec):
            return query
        if isinstance(query, str):
            query = json.loads(query)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in query.items() if k in known and v is not None})

    @property
    def is_ranking(self) -> bool:
        return self.operation == "model_specs" or self.analysis_type == "model_ranking"

    @property
    def is_specification(self) -> bool:
        return (
            self.intent == "specification"
            or self.operation in ("model_specs", "technical_analysis")
            or self.analysis_type in ("model_ranking", "technical_specs")
        )

    @property
    def below_totals(self) -> bool:
        """Whether it asks for something that TOTAL rows do not carry."""
        return bool(
            self.analysis_type == "trend"
            or [m for m in self.months if m != "all"]
            or self.filtered_segments
            or self.model
            or any(self.technical_filters.values())
        )

    @property
    def filtered_segments(self) -> list:
        """Segments to keep; a list that names the totals filters nothing."""
        if any(s in ("TOTAL:", "SUBTOTAL:") for s in self.segments):
            return []
        return self.segments
