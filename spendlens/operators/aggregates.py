"""Chart and dashboard aggregations.

Every aggregation groups a few low-cardinality dimensions, so Spark's
partial (map-side) aggregation collapses each input partition to at most one
row per group before the shuffle: the shuffle volume is independent of the
fact size and a hot group (one industry holding a third of all rows) costs no
more than any other.  Sums are taken over ``bigint`` columns so results do not
depend on the order of addition.  ``ordered=False`` skips a final global
sort when the caller fixes the order itself (a position window).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import age_sort_key
from ..schema import (DASHBOARD_UNIT, DIMENSIONS, HEATMAP_VALUE, HEATMAP_VALUE2,
                      OTHER_LABEL, PIE_OTHER_BELOW_PCT)
from .filters import ChartFilter, ChartParamsError, apply_filters, check_columns, clamp_topn


def group_sum(df: DataFrame, keys: list[str], value: str, alias: str = "raw_amount") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(alias))


def bar_sums(fact: DataFrame, x_axis: str, value: str, f: ChartFilter = ChartFilter(),
             dimensions=DIMENSIONS, ordered: bool = True) -> DataFrame:
    """A1: ``SUM(value)`` by ``x``.  Month axis: every month, ascending.
    Otherwise the top-N by sum (ties by label), which Spark plans as a
    per-partition top-N merged on one task (``TakeOrderedAndProject``)."""
    check_columns(x_axis, value=value, dimensions=dimensions)
    g = group_sum(apply_filters(fact, f.validate()).select(F.col(x_axis).alias("x"), value),
                  ["x"], value)
    if x_axis == "ym":
        return g.orderBy("x") if ordered else g
    return g.orderBy(F.desc("raw_amount"), F.asc("x")).limit(clamp_topn(f.topn))


def line_sums(fact: DataFrame, x_axis: str, value: str, f: ChartFilter = ChartFilter(),
              dimensions=DIMENSIONS, ordered: bool = True) -> DataFrame:
    """A2: like A1 but always ascending by label; the limit (non-month axes)
    keeps the first N labels, not the N largest."""
    check_columns(x_axis, value=value, dimensions=dimensions)
    g = group_sum(apply_filters(fact, f.validate()).select(F.col(x_axis).alias("x"), value),
                  ["x"], value)
    if x_axis == "ym":
        return g.orderBy("x") if ordered else g
    return g.orderBy("x").limit(clamp_topn(f.topn))


def pie_shares(fact: DataFrame, x_axis: str, value: str, f: ChartFilter = ChartFilter(),
               dimensions=DIMENSIONS, ordered: bool = True) -> DataFrame:
    """A3: each group's percentage of the filtered total, as an integer
    percent; groups under 10 % are folded into one "other" slice; then
    ordered (month axis: by label, no limit; else by share, top-N).

    The total is the sum of the group sums (a window over the aggregated
    groups), so the fact is scanned once instead of twice.
    """
    check_columns(x_axis, value=value, dimensions=dimensions)
    g = group_sum(apply_filters(fact, f.validate()).select(F.col(x_axis).alias("x"), value),
                  ["x"], value, "group_amount")
    total = F.sum("group_amount").over(_whole())
    ratio = F.try_divide(F.col("group_amount").cast("double"), total.cast("double"))
    pct = F.round(ratio * F.lit(100.0), 0)
    s = g.select(F.col("x"), pct.alias("pct"))
    s = s.select(F.when(F.col("pct") < PIE_OTHER_BELOW_PCT, F.lit(OTHER_LABEL))
                 .otherwise(F.col("x")).alias("x"), "pct")
    u = s.groupBy("x").agg(F.sum("pct").alias("amount"))
    if x_axis == "ym":
        return u.orderBy("x") if ordered else u
    return u.orderBy(F.desc("amount"), F.asc("x")).limit(clamp_topn(f.topn))


def heatmap_cells(fact: DataFrame, x_axis: str, y_axis: str,
                  value: str = HEATMAP_VALUE, value2: str = HEATMAP_VALUE2,
                  f: ChartFilter = ChartFilter(), dimensions=DIMENSIONS,
                  ordered: bool = True) -> DataFrame:
    """A4: average ticket ``SUM(value) / SUM(value2)`` per (x, y) cell;
    a zero divisor gives NULL.  Only the total/count pair is accepted.
    Ordered by (y, x) when an axis is the age band, else (x, y)."""
    if value != HEATMAP_VALUE or value2 != HEATMAP_VALUE2:
        raise ChartParamsError("heatmap only accepts trans_total / trans_count", "INVALID_METRIC", "value")
    if y_axis is None:
        raise ChartParamsError("heatmap needs y_axis", "HEATMAP_MISSING_Y_AXIS", "y_axis")
    if x_axis == y_axis:
        raise ChartParamsError("y_axis must differ from x_axis", "SAME_AXES", "y_axis")
    check_columns(x_axis, y_axis, value, value2, dimensions=dimensions)
    g = (apply_filters(fact, f.validate())
         .groupBy(F.col(x_axis).alias("x"), F.col(y_axis).alias("y"))
         .agg(F.sum(value).alias("num"), F.sum(value2).alias("den")))
    cells = g.select("x", "y", F.try_divide(F.col("num").cast("double"),
                                           F.col("den").cast("double")).alias("amount"))
    order = ["y", "x"] if "age_level" in (x_axis, y_axis) else ["x", "y"]
    return cells.orderBy(*order) if ordered else cells


def trend(base: DataFrame, unit: float = DASHBOARD_UNIT, digits: int = 4) -> DataFrame:
    """A5: ``SUM(trans_total) / unit`` per month, ascending."""
    return (base.groupBy("ym").agg(_unit_sum(unit, digits).alias("amount")).orderBy("ym"))


def month_industry(base: DataFrame, unit: float = DASHBOARD_UNIT, digits: int = 4,
                   ordered: bool = True) -> DataFrame:
    """Amount per (month, industry), by month then amount descending."""
    g = base.groupBy("ym", "industry").agg(_unit_sum(unit, digits).alias("amount"))
    return g.orderBy("ym", F.desc("amount"), "industry") if ordered else g


def industry_ranking(base: DataFrame, unit: float = DASHBOARD_UNIT, digits: int = 4) -> DataFrame:
    """Amount per industry, descending."""
    return (base.groupBy("industry").agg(_unit_sum(unit, digits).alias("amount"))
            .orderBy(F.desc("amount"), "industry"))


def distinct_values(fact: DataFrame, column: str) -> DataFrame:
    """Distinct sorted values of one column (a drop-down list)."""
    return fact.select(column).distinct().orderBy(column)


def overview_sets(base: DataFrame, unit: float = DASHBOARD_UNIT, digits: int = 4) -> DataFrame:
    """A11 in one pass: trend, per-month and per-industry sums as grouping
    sets ``((ym), (ym, industry), (industry))`` -- one scan, one shuffle.
    ``panel`` names the set each row belongs to.  Valid when the trend has no
    extra industry filter (see ``plans.dashboard`` for that case)."""
    g = base.groupingSets([["ym"], ["ym", "industry"], ["industry"]], "ym", "industry").agg(
        _unit_sum(unit, digits).alias("amount"), F.grouping_id().alias("gid"))
    panel = (F.when(F.col("gid") == 1, F.lit("trend"))
             .when(F.col("gid") == 0, F.lit("month_rank"))
             .otherwise(F.lit("rank")))
    return g.select(panel.alias("panel"), "ym", "industry", "amount")


def age_levels(fact: DataFrame) -> DataFrame:
    """Distinct age bands with their order key, in display order."""
    return (fact.select("age_level").distinct()
            .select("age_level", age_sort_key("age_level").alias("age_key"))
            .orderBy("age_key", "age_level"))


def _unit_sum(unit: float, digits: int):
    """``SUM(trans_total) / unit`` rounded half away from zero to ``digits``
    decimals, exactly as decimal arithmetic would: when ``unit`` is a power
    of ten at least ``10^digits`` the rounding is done on the integer sum
    (``(|s| + d/2) div d`` with ``d = unit / 10^digits``), so no binary
    fraction decides a tie.  Other units round the double quotient."""
    s = F.sum("trans_total")
    scale = 10 ** digits
    u = int(unit)
    d = u // scale if float(unit) == u and u % scale == 0 else 0
    if d and str(d).strip("0") == "1":
        q = F.floor((F.abs(s) + F.lit(d // 2)).cast("decimal(38,0)") / F.lit(d).cast("decimal(38,0)"))
        return F.signum(s) * q.cast("double") / F.lit(float(scale))
    return F.round(s.cast("double") / F.lit(float(unit)), digits)


def _whole():
    """A window over all rows.  Used only after an aggregation, where the
    row count is bounded by the number of groups."""
    from pyspark.sql import Window
    return Window.partitionBy()
