"""Sorting, reshaping and derived columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import age_sort_key
from ..functions.months import add_months_ym, ym_to_date
from ..functions.numbers import scaled_amount, unit_for
from ..schema import AGE_FIRST_LABEL, AXIS_HEADROOM, OTHER_LABEL, PIE_RELABEL_BELOW


def with_scaled(df: DataFrame, metric: str, raw: str = "raw_amount", name: str = "y",
                divisor: float | None = None) -> DataFrame:
    """Display amount = raw sum / metric unit, rounded to 2 (half-even)."""
    return df.withColumn(name, scaled_amount(F.col(raw), metric, divisor))


def unit_text(metric: str) -> str:
    return unit_for(metric)[1]


def relabel_small_slices(df: DataFrame, x: str = "x", amount: str = "amount") -> DataFrame:
    """Slices under 0.10 (percent) are labelled "other"."""
    return df.withColumn(x, F.when(F.col(amount) >= PIE_RELABEL_BELOW, F.col(x))
                         .otherwise(F.lit(OTHER_LABEL)))


def with_age_key(df: DataFrame, col: str = "age_level", name: str = "age_key") -> DataFrame:
    """Integer order key of an age band label."""
    return df.withColumn(name, age_sort_key(col))


def sort_by_age(df: DataFrame, col: str = "age_level") -> DataFrame:
    """Order by age key, then label."""
    return df.orderBy(age_sort_key(col), F.col(col))


def age_first_order(df: DataFrame, x: str = "x", pos: str = "pos", name: str = "draw_pos") -> DataFrame:
    """P5: drawing order of a line over age bands: trimmed labels starting
    with the 'under 20' label first, the rest keep their order."""
    first = F.when(F.trim(F.col(x)).startswith(AGE_FIRST_LABEL), 0).otherwise(1)
    return df.withColumn(name, F.row_number().over(Window.orderBy(first, F.col(pos))))


def pivot_matrix(cells: DataFrame, row: str = "y", col: str = "x", value: str = "amount",
                 values: list | None = None) -> DataFrame:
    """Long cells -> matrix, one row per ``row`` value (age order when the
    rows are age bands), one column per ``col`` value.  Passing ``values``
    avoids the extra job Spark runs to find the column values."""
    p = cells.groupBy(row).pivot(col, values).agg(F.first(value))
    return p.withColumn("row_key", age_sort_key(row))


def heatmap_coords(cells: DataFrame, x_axis: str, y_axis: str) -> DataFrame:
    """Matrix coordinates of each cell.  A category's index is its rank
    by first appearance in chart order (``pos``), or by age order when the
    axis is the age band; the value is rounded to an integer (half up)."""
    def idx(c: str, axis: str) -> Column:
        if axis == "age_level":
            return F.dense_rank().over(Window.orderBy(age_sort_key(c), F.col(c))) - 1
        return F.dense_rank().over(Window.orderBy(F.col(f"_first_{c}"))) - 1

    first = cells
    for c in ("x", "y"):
        first = first.withColumn(f"_first_{c}", F.min("pos").over(Window.partitionBy(c)))
    out = first.select("pos", "x", "y",
                       idx("x", x_axis).alias("x_idx"), idx("y", y_axis).alias("y_idx"),
                       F.floor(F.col("amount") + F.lit(0.5)).alias("value"))
    return out


def value_domain(cells: DataFrame, value: str = "amount") -> DataFrame:
    """(min, max) of the cell values."""
    return cells.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def axis_max(points: DataFrame, amount: str = "y") -> DataFrame:
    """Upper axis limit = largest amount x 1.1."""
    return points.agg((F.max(amount) * F.lit(AXIS_HEADROOM)).alias("axis_max"))


def normalize_months(df: DataFrame, col: str = "ym") -> DataFrame:
    """Trimmed, non-empty, not 'null', distinct, sorted month list."""
    m = F.trim(F.col(col).cast("string"))
    return (df.select(m.alias("ym")).where((F.col("ym") != "") & (F.col("ym") != "null"))
            .distinct().orderBy("ym"))


def month_neighbours(months: DataFrame, col: str = "ym") -> DataFrame:
    """Month arithmetic -- first day, previous and next month."""
    return months.select(
        F.col(col).alias("ym"), ym_to_date(col).alias("month_start"),
        add_months_ym(col, -1).alias("prev_ym"), add_months_ym(col, 1).alias("next_ym"))


def drop_nonfinite(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Drop rows whose amount is NULL, NaN or infinite."""
    a = F.col(amount).cast("double")
    return df.where(a.isNotNull() & ~F.isnan(a) & (F.abs(a) != F.lit(float("inf"))))
