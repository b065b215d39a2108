"""Column-level helpers: all return ``pyspark.sql.Column`` built from
built-in functions, so they stay inside whole-stage codegen."""
from .numbers import parse_number, finite_or_null, round_half_even, scaled_amount, unit_for
from .months import ym_to_date, date_to_ym, add_months_ym, is_valid_ym, year_start_ym
from .labels import age_sort_key, label_for, slug, period_label

__all__ = [
    "parse_number", "finite_or_null", "round_half_even", "scaled_amount", "unit_for",
    "ym_to_date", "date_to_ym", "add_months_ym", "is_valid_ym", "year_start_ym",
    "age_sort_key", "label_for", "slug", "period_label",
]
