"""Number parsing and rounding expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import UNITS

# A plain decimal literal: optional sign, digits with an optional fraction (or
# a bare fraction), optional exponent.  Anything else (hex, 'nan', 'inf',
# Java suffixes such as '1d') is unparsable, as for a coercing text parser.
# Whitespace of any kind (not only spaces) may stand around it.
_DECIMAL_LITERAL = r"(?U)^\s*+([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)\s*+$"


def literal_value(c: Column | str, thousands: str = "strip") -> Column:
    """``parse_number`` but for overflowing literals, which are infinite here.

    The text is searched once and stands once in the expression: Spark
    evaluates what stands in a condition and in its branch again for each."""
    c = F.col(c) if isinstance(c, str) else c
    txt = c.cast("string")
    if thousands == "strip":
        txt = F.replace(txt, F.lit(","), F.lit(""))
    elif thousands == "space":
        txt = F.replace(txt, F.lit(","), F.lit(" "))
    else:
        raise ValueError(f"thousands must be 'strip' or 'space', got {thousands!r}")
    # Without a match the extract is empty text, which is no number.
    return F.regexp_extract(txt, _DECIMAL_LITERAL, 1).try_cast("double")


def parse_number(c: Column | str, thousands: str = "strip") -> Column:
    """Text -> double; unparsable, non-finite or missing -> NULL.

    ``thousands='strip'`` removes ``,`` separators (``"1,234"`` -> 1234.0).
    ``thousands='space'`` replaces them by a space first, the literal
    behaviour of the original loader, which makes such values unparsable.
    """
    # An overflowing literal ('1e999') parses to infinity: missing as well.
    return finite_or_null(literal_value(c, thousands))


def finite_or_null(c: Column) -> Column:
    """NULL for NaN and +/-infinity, the value otherwise."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def round_half_even(c: Column, digits: int = 2) -> Column:
    """Round a double half-to-even on its scaled value, like numpy's round:
    ``rint(x * 10^d) / 10^d``."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def unit_for(metric: str) -> tuple[int, str]:
    """(divisor, unit text) for a metric column."""
    return UNITS.get(metric, (1, ""))


def scaled_amount(raw: Column, metric: str, divisor: float | None = None) -> Column:
    """Raw metric sum -> display amount: divide by the metric unit and round
    to two decimals (half-even)."""
    div = divisor if divisor is not None else unit_for(metric)[0]
    return round_half_even(raw.cast("double") / F.lit(float(div)), 2)
