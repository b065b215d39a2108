"""Label expressions: age ordering, display labels, slugs, period text."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from ..schema import AGE_FIRST_PREFIX, AGE_NO_NUMBER_KEY, HEATMAP_MEASURE, LABELS, UNITS


def age_sort_key(c: Column | str) -> Column:
    """Order key of an age band label: the 'under 20' band first (0), else the
    first integer in the label, else 999."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c.cast("string"))
    first_int = F.regexp_extract(s, r"([0-9]+)", 1).try_cast("int")
    return (F.when(s.startswith(AGE_FIRST_PREFIX), F.lit(0))
            .otherwise(F.coalesce(first_int, F.lit(AGE_NO_NUMBER_KEY))))


def label_for(c: Column | str) -> Column:
    """Display label of a column name, falling back to the name itself."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(LABELS.items())])
    return F.coalesce(m[c], c)


def slug(c: Column | str) -> Column:
    """File-name-safe text: anything but word characters, '-' and CJK becomes
    '-'; surrounding '_' are stripped."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(c, r"(?U)[^-\w]", "-")
    return F.regexp_replace(s, r"^_+|_+$", "")


def period_label(start: Column, end: Column, earliest: Column, latest: Column) -> Column:
    """``start-end`` with the table extent filling a missing side."""
    return F.concat_ws("-", F.coalesce(start, earliest), F.coalesce(end, latest))


def chart_title(chart_type: Column, x_axis: Column, y_axis: Column, value: Column, given: Column) -> Column:
    """A chart's title without its period: the given one (empty counts as none),
    else its labelled columns; bars and lines name their unit behind it.  Pies
    show column names, as their legends do."""
    given = F.nullif(given, F.lit(""))
    unit = F.lit(None).cast("string")
    for metric, (_, text) in UNITS.items():
        unit = F.when(value == metric, F.lit(" " + text)).otherwise(unit)
    sums = F.concat(F.coalesce(given, F.concat_ws(" x ", label_for(x_axis), label_for(value))), F.coalesce(unit, F.lit("")))
    cells = F.concat(F.lit("  "), F.concat_ws(" x ", label_for(x_axis), label_for(y_axis)), F.lit(HEATMAP_MEASURE))
    return (F.when(chart_type == "heatmap", F.coalesce(given, cells))
            .when(chart_type == "pie", F.coalesce(given, F.concat_ws(" x ", x_axis, value))).otherwise(sums))


def titled_period(chart_type: Column, period: Column, title: Column) -> Column:
    """The text above a chart: period and title, two blanks between for bars and lines."""
    gap = F.when(chart_type.isin("bar", "line"), F.lit("  ")).otherwise(F.lit(""))
    return F.trim(F.concat(F.coalesce(period, F.lit("")), gap, title))


def file_base(chart_type: Column, period: Column, title: Column) -> Column:
    """File name of a chart without its ending: period and title, empty ones
    skipped (``chart`` if both are), as a slug."""
    parts = [F.nullif(c, F.lit("")) for c in (period, title)]
    joined = F.when(chart_type == "heatmap", F.concat_ws("_", *parts)).otherwise(F.concat_ws("-", *parts))
    return slug(F.coalesce(F.nullif(joined, F.lit("")), F.lit("chart")))
