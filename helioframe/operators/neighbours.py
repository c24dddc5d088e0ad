"""Nearest known values around a row, and interpolation between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.operators.spans import HOUR


class Neighbours:
    """Helper columns holding the last known value up to a row and the next one after it.

    Both come from one ordered pass: a running aggregate and an offset that skips NULLs.
    (Sliding frames would recompute each frame for each row.)
    """

    def __init__(self, columns: Sequence[str], groups: Sequence[str]):
        self.columns = list(columns)
        self.groups = list(groups)

    def helpers(self) -> dict[str, Column]:
        order = Window.partitionBy(*self.groups).orderBy(HOUR)
        before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        keys = ", ".join(f"`{g}`" for g in self.groups)
        over = f"OVER ({f'PARTITION BY {keys} ' if keys else ''}ORDER BY `{HOUR}`)"
        out: dict[str, Column] = {}
        for c in self.columns:
            at = F.when(F.col(c).isNotNull(), F.col(HOUR))
            out[f"__x0_{c}"] = F.last(c, ignorenulls=True).over(before)
            out[f"__h0_{c}"] = F.last(at, ignorenulls=True).over(before)
            out[f"__x1_{c}"] = F.expr(f"lead(`{c}`) IGNORE NULLS {over}")
            out[f"__h1_{c}"] = F.expr(
                f"lead(CASE WHEN `{c}` IS NOT NULL THEN `{HOUR}` END) IGNORE NULLS {over}"
            )
        return out

    def value_at(self, column: str, hour: Column, max_gap_hours: int) -> Column:
        """The known value of ``hour``, else linear between neighbours of a short gap."""
        x0, h0, x1, h1 = (F.col(f"__{n}_{column}") for n in ("x0", "h0", "x1", "h1"))
        filled = x0 + (x1 - x0) * (hour - h0) / (h1 - h0)
        return F.when(h0 == hour, x0).when(h1 - h0 - 1 <= max_gap_hours, filled)

    def fill(self, df: DataFrame, max_gap_hours: int) -> DataFrame:
        """``df`` with the short gaps of the columns closed; needs the hour column."""
        names = list(self.helpers())
        hour = F.col(HOUR)
        filled = {c: self.value_at(c, hour, max_gap_hours) for c in self.columns}
        return df.withColumns(self.helpers()).withColumns(filled).drop(*names)
