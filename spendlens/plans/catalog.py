"""Query catalog: every registered analysis as a Spark plan plus the
equivalent DuckDB SQL used as an independent oracle.

Each Spark callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the whole driver tables (or data Spark derives from them).  Each SQL
string runs on DuckDB with the driver tables registered as views.  Column
names and types agree between the two (positions ``bigint``, sums
``bigint``, amounts ``double``).
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import shared_path, write_table
from ..operators import aggregates as A
from ..operators import reshape as P
from ..operators import windows as W
from ..operators.filters import ChartFilter, default_filters_row, extent, period_row
from ..sources.tables import fact_months, fact_table
from . import charts, dashboard


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, note: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, note)
        return fn
    return deco


# ---------------------------------------------------------------------------
# Oracle building blocks (DuckDB SQL)
# ---------------------------------------------------------------------------

FACT_LINES_SQL = """
fact_lines AS (
  SELECT l.l_orderkey, l.l_linenumber,
         strftime(l.l_shipdate, '%Y%m') AS ym,
         n.n_name AS nation,
         c.c_mktsegment AS industry,
         CASE WHEN p.p_size < 20 THEN '未滿20歲' WHEN p.p_size < 30 THEN '20(含)-30歲'
              WHEN p.p_size < 40 THEN '30(含)-40歲' ELSE '40(含)歲以上' END AS age_level,
         CAST(trunc(l.l_quantity) AS BIGINT) AS trans_count,
         CAST(round(l.l_extendedprice) AS BIGINT) AS trans_total
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey),
fact AS (SELECT ym, nation, industry, age_level, trans_count, trans_total FROM fact_lines)"""


def with_fact(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {FACT_LINES_SQL}{extra}\n{body}"


AGE_KEY_SQL = ("CASE WHEN starts_with(trim({c}), '未滿20') THEN 0 "
               "ELSE coalesce(TRY_CAST(nullif(regexp_extract(trim({c}), '([0-9]+)', 1), '') AS INTEGER), 999) END")


def age_key_sql(c: str) -> str:
    return AGE_KEY_SQL.format(c=c)


def rint2(expr: str) -> str:
    return f"round_even(({expr}) * 100.0, 0) / 100.0"


def filter_sql(f: ChartFilter) -> str:
    conds = []
    if f.start_month is not None:
        conds.append(f"ym >= '{f.start_month}'")
    if f.end_month is not None:
        conds.append(f"ym <= '{f.end_month}'")
    if f.industry is not None:
        conds.append(f"industry = '{f.industry}'")
    if f.age_level is not None:
        conds.append(f"age_level = '{f.age_level}'")
    return ("WHERE " + " AND ".join(conds)) if conds else ""


def bar_like_ctes(x: str, value: str, f: ChartFilter, div: float, by_size: bool,
                  limit: int | None, where: str | None = None) -> tuple[str, str]:
    """CTEs ``g`` (sums, ordered, limited) and ``pts`` (chart points)."""
    order = "raw_amount DESC, x ASC" if by_size else "x ASC"
    lim = f"LIMIT {limit}" if limit is not None else ""
    g = f"""g AS (SELECT {x} AS x, CAST(sum({value}) AS BIGINT) AS raw_amount FROM fact {where or filter_sql(f)}
                 GROUP BY {x} ORDER BY {order} {lim})"""
    pts = f"""pts AS (SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS pos,
                  x, y, {rint2('y / sum(y) OVER ()')} AS share, CAST(NULL AS DOUBLE) AS growth
           FROM (SELECT x, raw_amount, {rint2(f'CAST(raw_amount AS DOUBLE) / {float(div)!r}')} AS y FROM g))"""
    return g, pts


def bar_like_sql(x: str, value: str, f: ChartFilter, div: float, by_size: bool, limit: int | None) -> str:
    return with_fact("SELECT pos, x, y, share, growth FROM pts",
                     *bar_like_ctes(x, value, f, div, by_size, limit))


def _fact(spark: SparkSession, sf_dir: str, f: ChartFilter = ChartFilter()) -> DataFrame:
    """The fact of the filter's months."""
    start, end = (m if isinstance(m, str) else None for m in (f.start_month, f.end_month))
    return fact_table(spark, sf_dir, start, end)


# ---------------------------------------------------------------------------
# Scan (S3)
# ---------------------------------------------------------------------------

@register("src_fact", with_fact("SELECT * FROM fact"))
def q_src_fact(spark, sf_dir):
    """S3: the whole fact table."""
    return _fact(spark, sf_dir)


# ---------------------------------------------------------------------------
# Bar (A1 + F1-F4 + P1 + W1 + W3)
# ---------------------------------------------------------------------------

F_9699 = ChartFilter(start_month="199601", end_month="199912")
F_BUILDING = ChartFilter(industry="BUILDING", topn=2)


@register("agg_bar_industry", bar_like_sql("industry", "trans_total", F_9699, 1e9, True, 20))
def q_bar_industry(spark, sf_dir):
    return charts.bar_points(_fact(spark, sf_dir, F_9699), "industry", "trans_total", F_9699)


@register("agg_bar_industry_m", bar_like_sql("industry", "trans_total", F_9699, 1e6, True, 20))
def q_bar_industry_m(spark, sf_dir):
    return charts.bar_points(_fact(spark, sf_dir, F_9699), "industry", "trans_total", F_9699, divisor=1e6)


@register("agg_bar_ym", bar_like_sql("ym", "trans_count", ChartFilter(), 1e3, False, None))
def q_bar_ym(spark, sf_dir):
    return charts.bar_points(_fact(spark, sf_dir), "ym", "trans_count", divisor=1e3)


@register("agg_bar_age_top2", bar_like_sql("age_level", "trans_count", F_BUILDING, 1e3, True, 2))
def q_bar_age_top2(spark, sf_dir):
    return charts.bar_points(_fact(spark, sf_dir, F_BUILDING), "age_level", "trans_count", F_BUILDING, divisor=1e3)


# ---------------------------------------------------------------------------
# Line (A2)
# ---------------------------------------------------------------------------

F_MACH = ChartFilter(industry="MACHINERY")
F_TOP3 = ChartFilter(topn=3, age_level="未滿20歲")


@register("agg_line_ym", bar_like_sql("ym", "trans_total", F_MACH, 1e6, False, None))
def q_line_ym(spark, sf_dir):
    return charts.line_points(_fact(spark, sf_dir, F_MACH), "ym", "trans_total", F_MACH, divisor=1e6)


@register("agg_line_industry_top3", bar_like_sql("industry", "trans_total", F_TOP3, 1e6, False, 3))
def q_line_industry_top3(spark, sf_dir):
    return charts.line_points(_fact(spark, sf_dir, F_TOP3), "industry", "trans_total", F_TOP3, divisor=1e6)


# ---------------------------------------------------------------------------
# Pie (A3 + J1 + P2)
# ---------------------------------------------------------------------------

def pie_sql(x: str, value: str, f: ChartFilter, limit: int | None) -> str:
    order = "x ASC" if limit is None else "amount DESC, x ASC"
    lim = "" if limit is None else f"LIMIT {limit}"
    return with_fact(
        f"""SELECT pos, CASE WHEN amount >= 0.10 THEN x ELSE '其他' END AS x, amount
           FROM (SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS pos, x, amount
                 FROM u ORDER BY {order} {lim})""",
        f"""g AS (SELECT {x} AS x, sum({value}) AS group_amount FROM fact {filter_sql(f)} GROUP BY {x})""",
        """s AS (SELECT x, round(CAST(group_amount AS DOUBLE) / CAST(sum(group_amount) OVER () AS DOUBLE) * 100.0, 0) AS pct FROM g)""",
        """u AS (SELECT CASE WHEN pct < 10 THEN '其他' ELSE x END AS x, sum(pct) AS amount FROM s GROUP BY 1)""")


F_TAIL = ChartFilter(start_month="200105", end_month="200111")
DIMS_WITH_NATION = frozenset({"ym", "industry", "age_level", "nation"})


@register("agg_pie_age", pie_sql("age_level", "trans_total", ChartFilter(), 20))
def q_pie_age(spark, sf_dir):
    return charts.pie_points(_fact(spark, sf_dir), "age_level", "trans_total")


@register("agg_pie_ym_tail", pie_sql("ym", "trans_count", F_TAIL, None))
def q_pie_ym_tail(spark, sf_dir):
    return charts.pie_points(_fact(spark, sf_dir, F_TAIL), "ym", "trans_count", F_TAIL)


@register("agg_pie_nation", pie_sql("nation", "trans_total", ChartFilter(topn=5), 5),
          note="nation enabled as an extra dimension")
def q_pie_nation(spark, sf_dir):
    return charts.pie_points(_fact(spark, sf_dir), "nation", "trans_total", ChartFilter(topn=5),
                             dimensions=DIMS_WITH_NATION)


# ---------------------------------------------------------------------------
# Heatmap (A4 + P3/P4 + P7-P9)
# ---------------------------------------------------------------------------

def heatmap_sql(x: str, y: str, f: ChartFilter) -> str:
    order = "y, x" if "age_level" in (x, y) else "x, y"
    return with_fact(
        f"""SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS pos, x, y,
                  round(CAST(num AS DOUBLE) / CAST(nullif(den, 0) AS DOUBLE), 4) AS amount
           FROM (SELECT {x} AS x, {y} AS y, sum(trans_total) AS num, sum(trans_count) AS den
                 FROM fact {filter_sql(f)} GROUP BY {x}, {y})""")


F_BEFORE_98 = ChartFilter(end_month="199712", age_level="30(含)-40歲")


@register("agg_heatmap_industry_age", heatmap_sql("industry", "age_level", ChartFilter()))
def q_heatmap_industry_age(spark, sf_dir):
    return charts.heatmap_points(_fact(spark, sf_dir), "industry", "age_level")


@register("agg_heatmap_ym_industry", heatmap_sql("ym", "industry", F_BEFORE_98))
def q_heatmap_ym_industry(spark, sf_dir):
    return charts.heatmap_points(_fact(spark, sf_dir, F_BEFORE_98), "ym", "industry", F_BEFORE_98)


INDUSTRIES_SQL = "SELECT DISTINCT industry FROM fact"


@register("agg_heatmap_pivot", with_fact(
    f"""SELECT y AS age_level, {age_key_sql('y')} AS row_key,
              max(amount) FILTER (WHERE x = 'AUTOMOBILE') AS AUTOMOBILE,
              max(amount) FILTER (WHERE x = 'BUILDING') AS BUILDING,
              max(amount) FILTER (WHERE x = 'FURNITURE') AS FURNITURE,
              max(amount) FILTER (WHERE x = 'HOUSEHOLD') AS HOUSEHOLD,
              max(amount) FILTER (WHERE x = 'MACHINERY') AS MACHINERY
       FROM h GROUP BY y""",
    """h AS (SELECT industry AS x, age_level AS y,
                    round(CAST(sum(trans_total) AS DOUBLE) / CAST(nullif(sum(trans_count), 0) AS DOUBLE), 4) AS amount
             FROM fact GROUP BY 1, 2)"""),
    note="pivot columns are the industries present in the data")
def q_heatmap_pivot(spark, sf_dir):
    # Stored: finding the columns and filling them both read the cells, not the fact.
    cells = write_table(charts.heatmap_points(_fact(spark, sf_dir), "industry", "age_level"), shared_path(spark, "pivot-cells"))
    return P.pivot_matrix(cells).withColumnRenamed("y", "age_level")


@register("agg_heatmap_coords", with_fact(
    f"""SELECT pos, x, y,
              CAST(dense_rank() OVER (ORDER BY fx) - 1 AS INTEGER) AS x_idx,
              CAST(dense_rank() OVER (ORDER BY {age_key_sql('y')}, y) - 1 AS INTEGER) AS y_idx,
              CAST(floor(amount + 0.5) AS BIGINT) AS value
       FROM (SELECT *, min(pos) OVER (PARTITION BY x) AS fx FROM c)""",
    f"""c AS (SELECT CAST(row_number() OVER (ORDER BY y, x) AS BIGINT) AS pos, x, y,
                     round(CAST(num AS DOUBLE) / CAST(nullif(den, 0) AS DOUBLE), 4) AS amount
              FROM (SELECT industry AS x, age_level AS y, sum(trans_total) AS num, sum(trans_count) AS den
                    FROM fact GROUP BY 1, 2))"""))
def q_heatmap_coords(spark, sf_dir):
    cells = charts.heatmap_points(_fact(spark, sf_dir), "industry", "age_level")
    return P.heatmap_coords(cells, "industry", "age_level")


@register("agg_heatmap_domain", with_fact(
    """SELECT min(amount) AS min_value, max(amount) AS max_value FROM
       (SELECT round(CAST(sum(trans_total) AS DOUBLE) / CAST(nullif(sum(trans_count), 0) AS DOUBLE), 4) AS amount
        FROM fact GROUP BY industry, age_level)"""))
def q_heatmap_domain(spark, sf_dir):
    return P.value_domain(charts.heatmap_points(_fact(spark, sf_dir), "industry", "age_level"))


# ---------------------------------------------------------------------------
# Meta / period
# ---------------------------------------------------------------------------

@register("meta_extent", with_fact("SELECT min(ym) AS earliest_ym, max(ym) AS latest_ym FROM fact"))
def q_meta_extent(spark, sf_dir):
    """A8 from the months alone: folders and footers of a materialised fact."""
    return extent(fact_months(spark, sf_dir))


@register("meta_ym", with_fact("SELECT DISTINCT ym FROM fact"))
def q_meta_ym(spark, sf_dir):
    """A9 for months: from folders and footers of a materialised fact."""
    return fact_months(spark, sf_dir).select("ym").orderBy("ym")


@register("meta_industry", with_fact("SELECT DISTINCT industry FROM fact"))
def q_meta_industry(spark, sf_dir):
    return A.distinct_values(_fact(spark, sf_dir), "industry")


@register("meta_age_level", with_fact(
    f"SELECT age_level, {age_key_sql('age_level')} AS age_key FROM (SELECT DISTINCT age_level FROM fact)"))
def q_meta_age_level(spark, sf_dir):
    return A.age_levels(_fact(spark, sf_dir))


F_START_ONLY = ChartFilter(start_month="199806")


@register("period_label_start_only", with_fact(
    "SELECT '199806' AS start_month, max(ym) AS end_month, '199806-' || max(ym) AS period FROM fact"))
def q_period_label(spark, sf_dir):
    return period_row(_fact(spark, sf_dir), F_START_ONLY)


@register("period_default", with_fact(
    "SELECT substr(max(ym), 1, 4) || '01' AS start_month, max(ym) AS end_month FROM fact"))
def q_period_default(spark, sf_dir):
    return default_filters_row(_fact(spark, sf_dir))


@register("month_neighbours", with_fact(
    """SELECT ym, CAST(strptime(ym, '%Y%m') AS DATE) AS month_start,
              strftime(strptime(ym, '%Y%m') - INTERVAL 1 MONTH, '%Y%m') AS prev_ym,
              strftime(strptime(ym, '%Y%m') + INTERVAL 1 MONTH, '%Y%m') AS next_ym
       FROM (SELECT DISTINCT trim(ym) AS ym FROM fact WHERE trim(ym) <> '' AND trim(ym) <> 'null')"""))
def q_month_neighbours(spark, sf_dir):
    return P.month_neighbours(P.normalize_months(_fact(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Dashboard
# ---------------------------------------------------------------------------

DEFAULT_PERIOD_CTE = """per AS (SELECT substr(max(ym), 1, 4) || '01' AS s, max(ym) AS e FROM fact)"""
DASH_BASE_CTE = """base AS (SELECT f.* FROM fact f, per WHERE f.ym >= per.s AND f.ym <= per.e)"""


def unit_sum_sql(unit: float = 1e9, digits: int = 4) -> str:
    """Exact half-away-from-zero rounding of sum / unit (unit a power of ten)."""
    d = int(unit) // 10 ** digits
    return (f"CAST(sign(sum(trans_total)) * ((abs(sum(trans_total)) + {d // 2}) // {d}) AS DOUBLE)"
            f" / {float(10 ** digits)!r}")


@register("dash_trend", with_fact(
    f"SELECT ym, {unit_sum_sql()} AS amount FROM base GROUP BY ym", DEFAULT_PERIOD_CTE, DASH_BASE_CTE))
def q_dash_trend(spark, sf_dir):
    return dashboard.overview(_fact(spark, sf_dir)).trend


@register("dash_rank", with_fact(
    f"SELECT industry, {unit_sum_sql()} AS amount FROM base GROUP BY industry",
    DEFAULT_PERIOD_CTE, DASH_BASE_CTE))
def q_dash_rank(spark, sf_dir):
    return dashboard.overview(_fact(spark, sf_dir)).rank


@register("dash_month_rank", with_fact(
    """SELECT ym, industry, amount,
              CAST(row_number() OVER (PARTITION BY ym ORDER BY amount DESC, industry) AS INTEGER) AS rank
       FROM m WHERE amount IS NOT NULL AND NOT isnan(amount) AND NOT isinf(amount)""",
    DEFAULT_PERIOD_CTE, DASH_BASE_CTE,
    f"m AS (SELECT ym, industry, {unit_sum_sql()} AS amount FROM base GROUP BY ym, industry)"))
def q_dash_month_rank(spark, sf_dir):
    return dashboard.overview(_fact(spark, sf_dir)).month_rank


DASH_P = dict(start_month="199703", end_month="199810", industry="HOUSEHOLD", age_level="20(含)-30歲")


@register("dash_trend_filtered", with_fact(
    f"""SELECT ym, {unit_sum_sql(1e6)} AS amount FROM fact
        WHERE ym >= '199703' AND ym <= '199810' AND age_level = '20(含)-30歲' AND industry = 'HOUSEHOLD'
        GROUP BY ym"""))
def q_dash_trend_filtered(spark, sf_dir):
    return dashboard.overview(_fact(spark, sf_dir), unit=1e6, **DASH_P).trend


@register("dash_rank_end_only", with_fact(
    f"""SELECT industry, {unit_sum_sql(1e6)} AS amount FROM fact, (SELECT min(ym) AS s FROM fact) per
        WHERE ym >= per.s AND ym <= '199612' GROUP BY industry"""))
def q_dash_rank_end_only(spark, sf_dir):
    return dashboard.overview(_fact(spark, sf_dir), end_month="199612", unit=1e6).rank


@register("dash_overview_sets", with_fact(
    f"""SELECT 'trend' AS panel, ym, CAST(NULL AS VARCHAR) AS industry, {unit_sum_sql(1e6)} AS amount FROM b GROUP BY ym
        UNION ALL
        SELECT 'month_rank', ym, industry, {unit_sum_sql(1e6)} FROM b GROUP BY ym, industry
        UNION ALL
        SELECT 'rank', NULL, industry, {unit_sum_sql(1e6)} FROM b GROUP BY industry""",
    "b AS (SELECT * FROM fact WHERE ym >= '199801' AND age_level = '未滿20歲' AND ym <= (SELECT max(ym) FROM fact))"))
def q_dash_overview_sets(spark, sf_dir):
    return dashboard.overview_one_pass(_fact(spark, sf_dir), start_month="199801",
                                       age_level="未滿20歲", unit=1e6)


@register("dash_drill_month", with_fact(
    f"""SELECT ym, industry, amount,
              CAST(row_number() OVER (PARTITION BY ym ORDER BY amount DESC, industry) AS INTEGER) AS rank
       FROM (SELECT ym, industry, {unit_sum_sql(1e6)} AS amount FROM base GROUP BY ym, industry)
       WHERE ym = (SELECT max(ym) FROM base)""",
    DEFAULT_PERIOD_CTE, DASH_BASE_CTE))
def q_dash_drill_month(spark, sf_dir):
    return dashboard.month_drilldown(_fact(spark, sf_dir), unit=1e6)


# ---------------------------------------------------------------------------
# Growth, label thinning, drawing order, axis
# ---------------------------------------------------------------------------

@register("growth_industry_month", with_fact(
    """SELECT x, ym, y,
              round(y / lag(y) OVER (PARTITION BY x ORDER BY ym) - 1.0, 6) AS growth
       FROM (SELECT industry AS x, ym, round_even(CAST(sum(trans_total) AS DOUBLE) / 1000000.0 * 100.0, 0) / 100.0 AS y
             FROM fact GROUP BY industry, ym)"""))
def q_growth_industry_month(spark, sf_dir):
    return charts.growth_points(_fact(spark, sf_dir), "industry", "trans_total", divisor=1e6)


@register("line_label_thin", with_fact(
    """SELECT x, y, CAST(greatest(1, ceil(count(*) OVER () / 12.0)) AS BIGINT) AS label_step,
              (row_number() OVER (ORDER BY x) - 1) % CAST(greatest(1, ceil(count(*) OVER () / 12.0)) AS BIGINT) = 0 AS show_label
       FROM (SELECT ym AS x, round_even(CAST(sum(trans_total) AS DOUBLE) / 1000000.0 * 100.0, 0) / 100.0 AS y
             FROM fact GROUP BY ym)"""))
def q_line_label_thin(spark, sf_dir):
    pts = charts.line_points(_fact(spark, sf_dir), "ym", "trans_total", divisor=1e6)
    return W.with_label_step(pts.select("x", "y"), "x")


@register("line_age_draw_order", with_fact(
    """SELECT pos, x, y,
              CAST(row_number() OVER (ORDER BY CASE WHEN starts_with(trim(x), '未滿20歲') THEN 0 ELSE 1 END, pos) AS INTEGER) AS draw_pos
       FROM (SELECT CAST(row_number() OVER (ORDER BY x) AS BIGINT) AS pos, x,
                    round_even(CAST(sum_v AS DOUBLE) / 1000.0 * 100.0, 0) / 100.0 AS y
             FROM (SELECT age_level AS x, sum(trans_count) AS sum_v FROM fact GROUP BY age_level))"""))
def q_line_age_draw_order(spark, sf_dir):
    pts = charts.line_points(_fact(spark, sf_dir), "age_level", "trans_count", divisor=1e3)
    return P.age_first_order(pts.select("pos", "x", "y"))


@register("axis_max_bar", with_fact(
    """SELECT max(y) * 1.1 AS axis_max FROM
       (SELECT round_even(CAST(sum(trans_total) AS DOUBLE) / 1000000.0 * 100.0, 0) / 100.0 AS y
        FROM fact WHERE ym >= '199601' AND ym <= '199912' GROUP BY industry ORDER BY 1 DESC LIMIT 20)"""))
def q_axis_max_bar(spark, sf_dir):
    return P.axis_max(charts.bar_points(_fact(spark, sf_dir, F_9699), "industry", "trans_total", F_9699, divisor=1e6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: q.run for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}


def _load_all():
    """Import the modules that register further queries."""
    from . import catalog_clean, catalog_requests, catalog_results, catalog_stream  # noqa: F401


# ---------------------------------------------------------------------------
# Points document
# ---------------------------------------------------------------------------

@register("doc_bar_industry", with_fact(
    """SELECT 'agg_bar_industry' AS chart,
              '[' || string_agg('{' || concat_ws(',', '"x":' || to_json(x),
                                         CASE WHEN y IS NOT NULL THEN '"y":' || CAST(y AS VARCHAR) END,
                                         CASE WHEN share IS NOT NULL THEN '"share":' || CAST(share AS VARCHAR) END)
                                || '}', ',' ORDER BY pos) || ']' AS points_json
       FROM pts""",
    *bar_like_ctes("industry", "trans_total", F_9699, 1e6, True, 20)))
def q_doc_bar_industry(spark, sf_dir):
    """The bar chart's points as one JSON array document (NULL fields
    left out, chart order)."""
    from ..operators.requests_log import points_document
    pts = charts.bar_points(_fact(spark, sf_dir, F_9699), "industry", "trans_total", F_9699, divisor=1e6)
    return points_document(pts.withColumn("chart", F.lit("agg_bar_industry")), ["chart"])


# ---------------------------------------------------------------------------
# Canned analyses under the default period (F9 presets)
# ---------------------------------------------------------------------------

PRESET_WHERE = ("WHERE ym >= (SELECT substr(max(ym), 1, 4) || '01' FROM fact) "
                "AND ym <= (SELECT max(ym) FROM fact)")


@register("preset_bar_industry", with_fact(
    "SELECT pos, x, y, share, growth FROM pts",
    *bar_like_ctes("industry", "trans_total", ChartFilter(), 1e9, True, 20, where=PRESET_WHERE)))
def q_preset_bar_industry(spark, sf_dir):
    """Canned analysis 1: spend by industry, January of the latest year to
    the latest month, default units."""
    from ..operators.filters import preset_filter
    fact = _fact(spark, sf_dir)
    return charts.bar_points(fact, "industry", "trans_total", preset_filter(fact))


@register("preset_heatmap_industry_age", with_fact(
    f"""SELECT CAST(row_number() OVER (ORDER BY y, x) AS BIGINT) AS pos, x, y,
              round(CAST(num AS DOUBLE) / CAST(nullif(den, 0) AS DOUBLE), 4) AS amount
       FROM (SELECT industry AS x, age_level AS y, sum(trans_total) AS num, sum(trans_count) AS den
             FROM fact {PRESET_WHERE} GROUP BY 1, 2)"""))
def q_preset_heatmap_industry_age(spark, sf_dir):
    """Canned analysis 2: average ticket by industry and age band over the
    default period."""
    from ..operators.filters import preset_filter
    fact = _fact(spark, sf_dir)
    return charts.heatmap_points(fact, "industry", "age_level", preset_filter(fact))
