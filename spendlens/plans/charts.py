"""Chart point sets: filter -> aggregate -> derive, one lazy plan each.

Output columns follow the point record ``(x, y, amount, share, growth)``;
each chart fills the fields it uses and adds ``pos`` (1-based chart order).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as A
from ..operators.filters import ChartFilter
from ..operators.reshape import with_scaled
from ..operators.windows import with_growth, with_position, with_share
from ..schema import DIMENSIONS


def bar_points(fact: DataFrame, x_axis: str, value: str, f: ChartFilter = ChartFilter(),
               divisor: float | None = None, dimensions=DIMENSIONS) -> DataFrame:
    """Bar chart: A1 -> P1 unit scaling -> W1 share; growth absent."""
    g = A.bar_sums(fact, x_axis, value, f, dimensions, ordered=False)
    order = [F.col("x")] if x_axis == "ym" else [F.desc("raw_amount"), F.asc("x")]
    pts = with_position(with_scaled(g, value, divisor=divisor), *order)
    pts = with_growth(with_share(pts, "y"), None, None)
    return pts.select("pos", "x", "y", "share", "growth")


def line_points(fact: DataFrame, x_axis: str, value: str, f: ChartFilter = ChartFilter(),
                divisor: float | None = None, dimensions=DIMENSIONS) -> DataFrame:
    """Line chart: A2 -> P1 -> W1; growth absent."""
    g = A.line_sums(fact, x_axis, value, f, dimensions, ordered=False)
    pts = with_position(with_scaled(g, value, divisor=divisor), F.col("x"))
    pts = with_growth(with_share(pts, "y"), None, None)
    return pts.select("pos", "x", "y", "share", "growth")


def pie_points(fact: DataFrame, x_axis: str, value: str, f: ChartFilter = ChartFilter(),
               dimensions=DIMENSIONS) -> DataFrame:
    """Pie chart: A3 (+ J1 total, P2 relabel); ``amount`` is a percentage."""
    from ..operators.reshape import relabel_small_slices
    u = A.pie_shares(fact, x_axis, value, f, dimensions, ordered=False)
    order = [F.col("x")] if x_axis == "ym" else [F.desc("amount"), F.asc("x")]
    pts = with_position(u, *order)
    return relabel_small_slices(pts).select("pos", "x", "amount")


def heatmap_points(fact: DataFrame, x_axis: str, y_axis: str, f: ChartFilter = ChartFilter(),
                   value: str = "trans_total", value2: str = "trans_count",
                   digits: int = 4, dimensions=DIMENSIONS) -> DataFrame:
    """Heatmap: A4 average ticket per cell, rounded to ``digits``."""
    cells = A.heatmap_cells(fact, x_axis, y_axis, value, value2, f, dimensions, ordered=False)
    order = ["y", "x"] if "age_level" in (x_axis, y_axis) else ["x", "y"]
    pts = with_position(cells.withColumn("amount", F.round("amount", digits)), *order)
    return pts.select("pos", "x", "y", "amount")


def growth_points(fact: DataFrame, group_col: str, value: str, f: ChartFilter = ChartFilter(),
                  divisor: float | None = None) -> DataFrame:
    """W2 over a (group, month) series: monthly amount per group and its
    change against the group's previous month with data."""
    from ..operators.filters import apply_filters
    g = (apply_filters(fact, f.validate()).groupBy(F.col(group_col).alias("x"), "ym")
         .agg(F.sum(value).alias("raw_amount")))
    pts = with_growth(with_scaled(g, value, divisor=divisor), "x", "ym", amount="y")
    return pts.select("x", "ym", "y", F.round("growth", 6).alias("growth"))
