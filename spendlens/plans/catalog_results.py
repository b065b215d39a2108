"""Queries over altered logs and files (registered into the catalog): broken
rules, results without data, composed titles, files that differ in form, and
charts after an append."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import data_version, session_table, shared_path
from ..functions import labels as L
from ..operators import clean as C
from ..operators import requests_log as R
from ..operators.filters import ChartFilter, extent
from ..sources.extracts import ingest
from ..sources.sinks import append_new_rows, cluster_fact, read_fact, write_fact
from ..sources.tables import fact_table, read_table
from . import charts, etl
from .catalog import F_9699, bar_like_sql, register
from .catalog_clean import CLEAN_SQL
from .catalog_requests import REQ_SQL, SERVE_HEATMAP_SQL, SERVE_PIE_SQL, SERVE_SQL
from .fixtures import RAW_HEADERS, dirty_extract, request_log
from .serving import result_points, stored_lookup


def _altered(sql: str, replace: str) -> str:
    """The oracle over the request log with some columns replaced."""
    return sql.replace("keyed AS (", f"altered AS (SELECT * REPLACE ({replace}) FROM req),\nkeyed AS (").replace(
        "FROM req),\nchecked", "FROM altered),\nchecked")


# ---------------------------------------------------------------------------
# Broken rules
# ---------------------------------------------------------------------------

@register("req_broken_rules", _altered(REQ_SQL, """CASE WHEN x_axis = 'ym' THEN 'nation' ELSE x_axis END AS x_axis,
    end_month AS start_month, start_month AS end_month, topn - 10 AS topn""")
          + "SELECT id, chart_type, error_codes = '' AS accepted, error_codes FROM checked")
def q_req_broken_rules(spark, sf_dir):
    """The log with an axis that is no dimension, its months
    exchanged and small limits."""
    x = F.col("params.x_axis")
    log = request_log(spark, sf_dir).select(
        "id", "chart_type", F.col("params").withField("x_axis", F.when(x == "ym", "nation").otherwise(x)).alias("params"), "figure",
        F.col("filters").withField("start_month", F.col("filters.end_month")).withField("end_month", F.col("filters.start_month"))
        .withField("topn", F.col("filters.topn") - 10).alias("filters"))
    return R.validate(log).select("id", "chart_type", "accepted", "error_codes")


# ---------------------------------------------------------------------------
# Result records with points, status and title
# ---------------------------------------------------------------------------

ABSENT = "CASE WHEN id % 2 = 0 AND industry IS NOT NULL THEN 'NO SUCH' ELSE industry END AS industry"


def _absent_log(spark, sf_dir):
    """The log in which every other industry filter names an industry without
    data, accepted requests only, stored with its firsts."""
    version = f"{sf_dir}@{data_version(read_table(spark, sf_dir, 'events'))}"

    def build():
        industry = F.col("filters.industry")
        given = F.when((F.col("id") % 2 == 0) & industry.isNotNull(), F.lit("NO SUCH")).otherwise(industry)
        log = request_log(spark, sf_dir).withColumn("filters", F.col("filters").withField("industry", given))
        return R.validate(R.with_fingerprint(log)).where("accepted").drop("accepted", "error_codes")
    log = session_table(spark, "request_log_absent", version, build)
    return log, session_table(spark, "request_firsts_absent", version, lambda: R.first_requests(log))


@register("req_results_points", f"""WITH charts AS (
  SELECT cache_key FROM ({_altered(SERVE_SQL, ABSENT)}) UNION ALL
  SELECT cache_key FROM ({_altered(SERVE_PIE_SQL, ABSENT)}) UNION ALL
  SELECT cache_key FROM ({_altered(SERVE_HEATMAP_SQL, ABSENT)})),
n AS (SELECT cache_key, count(*) AS n_points FROM charts GROUP BY cache_key),
keys AS ({_altered(REQ_SQL, ABSENT)} SELECT f.first_id AS result_id, a.cache_key, a.chart_type
         FROM firsts f JOIN acc a ON a.id = f.first_id AND a.cache_key = f.cache_key)
SELECT result_id, cache_key, chart_type, CASE WHEN n_points > 0 THEN 'READY' ELSE 'FAILED' END AS status,
       CASE WHEN n_points > 0 THEN NULL ELSE 'NO_DATA' END AS error_code, CAST(coalesce(n_points, 0) AS BIGINT) AS n_points
FROM keys LEFT JOIN n USING (cache_key)""")
def q_req_results_points(spark, sf_dir):
    """Every accepted key's result record with its points; a chart
    without data has failed, and no request is lost."""
    log, firsts = _absent_log(spark, sf_dir)
    fact = fact_table(spark, sf_dir)
    records = R.result_records(log, firsts=firsts, points=result_points(fact, log, stored_lookup(spark, fact, sf_dir)))
    return records.select("result_id", "cache_key", "chart_type", "status",
                          F.when(F.col("status") == "FAILED", F.lit("NO_DATA")).alias("error_code"),
                          F.coalesce(F.json_array_length("points_json"), F.lit(0)).cast("bigint").alias("n_points"))


def _label_sql(c: str) -> str:
    return (f"CASE {c} WHEN 'ym' THEN '年月' WHEN 'industry' THEN '產業別' WHEN 'age_level' THEN '年齡層'"
            f" WHEN 'trans_count' THEN '交易筆數' WHEN 'trans_total' THEN '交易金額' ELSE {c} END")


@register("chart_titles", REQ_SQL + f"""
SELECT result_id, trim(period || CASE WHEN chart_type IN ('bar', 'line') THEN '  ' ELSE '' END || title, ' ') AS title,
       trim(regexp_replace(period || CASE chart_type WHEN 'heatmap' THEN '_' ELSE '-' END || title,
                           '[^-_\\p{{L}}\\p{{N}}]', '-', 'g'), '_') AS file_base
FROM (
  SELECT f.first_id AS result_id, chart_type,
         coalesce(start_month, (SELECT strftime(min(l_shipdate), '%Y%m') FROM lineitem)) || '-'
           || coalesce(end_month, (SELECT strftime(max(l_shipdate), '%Y%m') FROM lineitem)) AS period,
         CASE chart_type WHEN 'heatmap' THEN coalesce(set_title, '  ' || {_label_sql('x_axis')} || ' x ' || {_label_sql('y_axis')} || '_平均交易金額')
              WHEN 'pie' THEN coalesce(set_title, x_axis || ' x ' || value)
              ELSE coalesce(set_title, {_label_sql('x_axis')} || ' x ' || {_label_sql('value')})
                   || CASE value WHEN 'trans_count' THEN '  (單位：千萬筆) ' ELSE '  (單位：十億元)' END END AS title
  FROM firsts f JOIN acc a ON a.id = f.first_id AND a.cache_key = f.cache_key)""".replace("\\\\", "\\"))
def q_chart_titles(spark, sf_dir):
    """P10, F8, slugs: title and file name of every result record's chart."""
    from .catalog_requests import _accepted, _firsts
    ends = extent(fact_table(spark, sf_dir))
    least, most = (ends.select(c).scalar() for c in ("earliest_ym", "latest_ym"))
    p, kind = F.col("params"), F.col("chart_type")
    period = L.period_label(F.col("filters.start_month"), F.col("filters.end_month"), least, most)
    named = (_firsts(spark, sf_dir).select(F.col("first_id").alias("id"))
             .join(_accepted(spark, sf_dir), "id")
             .select(F.col("id").alias("result_id"), "chart_type", period.alias("period"),
                     L.chart_title(kind, p["x_axis"], p["y_axis"], p["value"], F.col("figure.set_title")).alias("title")))
    return named.select("result_id", L.titled_period(kind, F.col("period"), F.col("title")).alias("title"),
                        L.file_base(kind, F.col("period"), F.col("title")).alias("file_base"))


# ---------------------------------------------------------------------------
# Files of several forms (S1, S2), charts after an append
# ---------------------------------------------------------------------------

@register("src_csv_mixed_headers", CLEAN_SQL)
def q_src_csv_mixed_headers(spark, sf_dir):
    """Half of the files have their columns in another order."""
    path = shared_path(spark, "extract-orders")
    rows = dirty_extract(spark, sf_dir, keep_ids=True)
    for k, headers in enumerate((RAW_HEADERS, RAW_HEADERS[::-1])):
        etl.write_extract(rows.where(F.col("l_orderkey") % 2 == k), "csv", f"{path}/{k}", headers)
    return C.clean_extract(ingest(spark, "csv", f"{path}/*"))


def _auto(layout: str):
    def run(spark, sf_dir):
        path = shared_path(spark, f"extract-auto-{layout}")
        etl.write_extract(dirty_extract(spark, sf_dir, keep_ids=True), layout, path, RAW_HEADERS)
        raw = ingest(spark, "json", path)
        return C.clean_extract(raw.drop("block"))
    run.__doc__ = f"S2: {layout} documents, the layout found file by file."
    return run


for _layout in ("wrapped", "keyed"):
    register(f"src_json_auto_{_layout}", CLEAN_SQL)(_auto(_layout))


@register("etl_append_then_chart", bar_like_sql("industry", "trans_total", F_9699, 1e9, True, 20))
def q_etl_append_then_chart(spark, sf_dir):
    """A chart is drawn, later months are appended, and the same chart
    then counts them."""
    path = shared_path(spark, "fact-appended")
    # Sums per month and industry: an append drops equal rows, of which the fact itself may hold some.
    fact = fact_table(spark, sf_dir).groupBy("ym", "industry").agg(F.sum("trans_total").alias("trans_total"))
    fact = fact.select("ym", F.lit(None).cast("string").alias("nation"), "industry", F.lit(None).cast("string").alias("age_level"),
                       F.lit(0).cast("bigint").alias("trans_count"), "trans_total")
    for months in (F.col("ym") < "199801", F.col("ym") >= "199801"):
        append_new_rows(spark, fact.where(months), path)
        chart = charts.bar_points(read_fact(spark, path), "industry", "trans_total", F_9699)
    return chart


BUILDING_MONTHS = ChartFilter(industry="BUILDING")


@register("agg_bar_ym_clustered", bar_like_sql("ym", "trans_count", BUILDING_MONTHS, 1e3, False, None))
def q_bar_ym_clustered(spark, sf_dir):
    """one industry by month over a fact in files clustered by industry and age band."""
    path = shared_path(spark, "fact-plain")
    write_fact(fact_table(spark, sf_dir), path)
    clustered = cluster_fact(spark, path, shared_path(spark, "fact-clustered"))
    return charts.bar_points(read_fact(spark, clustered), "ym", "trans_count", BUILDING_MONTHS, divisor=1e3)
