"""Window / analytic operators.

The global windows here (share, position, label thinning) run after an
aggregation or a top-N, where the input is bounded by the number of groups
(months, at most 200 labels), so the single window partition stays tiny.
Partitioned windows (growth, per-month rank) partition by the group key of
already-aggregated rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import MAX_AXIS_LABELS
from ..functions.numbers import round_half_even


def with_position(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """1-based position of each row in the given order (chart order)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def with_share(df: DataFrame, amount: str = "y", digits: int = 2, name: str = "share") -> DataFrame:
    """Each row's part of the sum of the returned rows, rounded."""
    total = F.sum(amount).over(Window.partitionBy())
    return df.withColumn(name, round_half_even(F.try_divide(F.col(amount), total), digits))


def with_growth(df: DataFrame, group_col: str | None, time_col: str | None,
                amount: str = "y", name: str = "growth") -> DataFrame:
    """Period-over-period change ``cur / prev - 1`` within each group
    in time order.  The first row of a group has none; a missing amount
    carries the previous one forward; growth from zero is NULL.  Without a
    time column the growth is absent (NULL)."""
    if time_col is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    w = Window.orderBy(time_col) if group_col is None else Window.partitionBy(group_col).orderBy(time_col)
    prev = F.last(F.col(amount), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cur = F.coalesce(F.col(amount), prev)
    return df.withColumn(name, F.try_divide(cur.cast("double"), prev.cast("double")) - F.lit(1.0))


def rank_within(df: DataFrame, partition: str, amount: str = "amount", label: str = "industry",
                name: str = "rank", top: int | None = None) -> DataFrame:
    """Rank of each row inside its partition by amount descending (ties by
    label); ``top`` keeps the first N of each partition."""
    w = Window.partitionBy(partition).orderBy(F.desc(amount), F.asc(label))
    out = df.withColumn(name, F.row_number().over(w))
    return out if top is None else out.where(F.col(name) <= top)


def drill_month(ranked: DataFrame, trend: DataFrame, end_month: str | None) -> DataFrame:
    """Rows of the selected month -- the given end month, else the last
    month of the trend."""
    month = F.lit(end_month) if end_month else trend.agg(F.max("ym")).scalar()
    return ranked.where(F.col("ym") == month)


def with_label_step(df: DataFrame, order: str = "x", max_labels: int = MAX_AXIS_LABELS,
                    name: str = "show_label") -> DataFrame:
    """Keep every step-th label, ``step = max(1, ceil(n / max_labels))``."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    step = F.greatest(F.lit(1), F.ceil(n / F.lit(float(max_labels))))
    pos = F.row_number().over(Window.orderBy(order))
    return (df.withColumn("_pos", pos).withColumn("label_step", step)
              .withColumn(name, ((F.col("_pos") - 1) % F.col("label_step")) == 0)
              .drop("_pos"))
