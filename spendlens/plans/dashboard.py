"""Three-panel dashboard over one shared base."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as A
from ..operators.filters import resolved_period
from ..operators.reshape import drop_nonfinite
from ..operators.windows import drill_month, rank_within
from ..schema import DASHBOARD_UNIT


@dataclass
class Overview:
    trend: DataFrame
    rank: DataFrame
    month_rank: DataFrame


def dashboard_base(fact: DataFrame, start_month: str | None = None, end_month: str | None = None,
                   age_level: str | None = None) -> DataFrame:
    """the period (defaults resolved against the table extent) and the
    age filter apply to every panel."""
    start, end = resolved_period(fact, start_month, end_month)
    base = fact.where((F.col("ym") >= start) & (F.col("ym") <= end))
    if age_level is not None:
        base = base.where(F.col("age_level") == F.lit(age_level))
    return base


def overview(fact: DataFrame, start_month: str | None = None, end_month: str | None = None,
             industry: str | None = None, age_level: str | None = None,
             unit: float = DASHBOARD_UNIT) -> Overview:
    """Trend (industry filter applies here only), industry ranking and
    per-month industry ranking.  Three lazy DataFrames over one base; when
    they run in one job, Spark reuses the shared scan's exchange."""
    base = dashboard_base(fact, start_month, end_month, age_level)
    trend_base = base if industry is None else base.where(F.col("industry") == F.lit(industry))
    month_rank = rank_within(drop_nonfinite(A.month_industry(base, unit, ordered=False)), "ym")
    return Overview(trend=A.trend(trend_base, unit),
                    rank=A.industry_ranking(base, unit),
                    month_rank=month_rank.orderBy("ym", "rank"))


def overview_one_pass(fact: DataFrame, start_month: str | None = None, end_month: str | None = None,
                      age_level: str | None = None, unit: float = DASHBOARD_UNIT) -> DataFrame:
    """A11 as grouping sets: all three panels from one scan and one shuffle
    (no industry filter, so every panel shares the same base)."""
    return A.overview_sets(dashboard_base(fact, start_month, end_month, age_level), unit)


def month_drilldown(fact: DataFrame, start_month: str | None = None, end_month: str | None = None,
                    industry: str | None = None, age_level: str | None = None,
                    unit: float = DASHBOARD_UNIT) -> DataFrame:
    """The selected month's industry ranking (end month, else the last
    month of the trend)."""
    ov = overview(fact, start_month, end_month, industry, age_level, unit)
    return drill_month(ov.month_rank, ov.trend, end_month)
