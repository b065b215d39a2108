"""Month (``YYYYMM`` text) expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_YM = re.compile(r"^[0-9]{4}(0[1-9]|1[0-2])$")


def is_valid_ym(value: str | None) -> bool:
    """Driver-side check of a month parameter (``YYYYMM``, month 01-12)."""
    return value is None or bool(_YM.match(str(value)))


def ym_to_date(c: Column | str) -> Column:
    """``YYYYMM`` -> first day of that month; malformed text -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(F.try_to_timestamp(c, F.lit("yyyyMM")))


def date_to_ym(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyyMM")


def add_months_ym(c: Column | str, n: int | Column) -> Column:
    """Shift a ``YYYYMM`` month by ``n`` months."""
    n = F.lit(n) if isinstance(n, int) else n
    return date_to_ym(F.add_months(ym_to_date(c), n))


def year_start_ym(c: Column | str) -> Column:
    """January of the year of a ``YYYYMM`` month."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.substring(c, 1, 4), F.lit("01"))
