"""The seven tables of the model, lazily."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..constants import TABLE_NAMES
from ..operators import profile, views
from ..operators.filters import keep_in
from ..operators.totals import totals, with_totals


class SalesTables:
    """The tables by name. Each is taken from ``stored`` if given there, else derived.

    ``detail`` is the fact table without TOTAL rows.
    """

    def __init__(self, detail: DataFrame, **stored: DataFrame):
        unknown = set(stored) - {*TABLE_NAMES, "totals", "rollup", "sketches"}
        if unknown:
            raise ValueError(f"not tables of the model: {sorted(unknown)}")
        self.detail = detail
        self.stored = stored

    @cached_property
    def totals(self) -> DataFrame:
        return self.stored.get("totals") or totals(self.detail)

    @cached_property
    def master(self) -> DataFrame:
        return self.stored.get("master") or with_totals(self.detail, self.totals)

    @cached_property
    def summary(self) -> DataFrame:
        return self.stored.get("summary") or self.totals.drop(*views.FLAG_COLUMNS)

    @cached_property
    def detailed(self) -> DataFrame:
        return self.stored.get("detailed") or self.detail.drop(*views.FLAG_COLUMNS)

    @cached_property
    def monthly(self) -> DataFrame:
        return self.stored.get("monthly") or views.monthly(self.master)

    @cached_property
    def brand_comparison(self) -> DataFrame:
        return self.stored.get("brand_comparison") or views.brand_comparison(self.detail)

    @cached_property
    def specs_only(self) -> DataFrame:
        return self.stored.get("specs_only") or views.specs_only(self.master)

    @cached_property
    def sales_only(self) -> DataFrame:
        return self.stored.get("sales_only") or views.sales_only(self.master)

    @property
    def primary(self) -> DataFrame:
        """What a question reads when nothing in it asks for more: the TOTAL rows."""
        return self.summary

    def distinct_counts(self, columns: list[str], years: list[int] | None = None, brands: list[str] | None = None,
                        exact: bool = False) -> DataFrame:
        """The number of distinct values of columns in vehicle rows of some years and brands: from the
        stored sketches, where they have the columns (see ``profile.SKETCH_ERROR``), or exactly."""
        stored = not exact and self.has_stored("sketches") and set(columns) <= set(profile.SKETCHED)
        rows = self.stored["sketches"] if stored else self.detail
        rows = keep_in(keep_in(rows, "year", years or []), "brand", brands or [])
        return profile.merged_distinct_counts(rows, columns) if stored else profile.distinct_counts(rows, columns)

    def has_stored(self, name: str) -> bool:
        return name in self.stored

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise KeyError(name)
        return getattr(self, name)
