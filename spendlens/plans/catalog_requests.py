"""Request-log queries (registered into the catalog).

The log is derived from ``events`` (``fixtures.request_log``); the oracle
rebuilds it with the same rules in ``REQ_SQL``.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requests_log as R
from ..config import data_version, session_table
from ..sources.tables import read_table
from .catalog import FACT_LINES_SQL, register
from .fixtures import request_log

REQ_SQL = """
WITH ev AS (
  SELECT event_id AS id, ts, user_id,
         CASE event_type WHEN 'click' THEN 'bar' WHEN 'view' THEN 'line' WHEN 'purchase' THEN 'pie'
                         WHEN 'signup' THEN 'heatmap' ELSE 'scatter' END AS chart_type,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
req AS (
  SELECT id, chart_type, user_id AS create_by, ts AS create_at,
         ['ym', 'industry', 'age_level'][user_id % 3 + 1] AS x_axis,
         CASE WHEN chart_type = 'heatmap' THEN ['ym', 'industry', 'age_level'][(user_id + 1) % 3 + 1]
              WHEN k % 3 = 0 THEN NULL
              ELSE ['ym', 'industry', 'age_level'][(user_id + k % 4) % 3 + 1] END AS y_axis,
         ['trans_count', 'trans_total'][k % 2 + 1] AS value,
         CASE WHEN chart_type = 'heatmap' THEN 'trans_count' END AS value2,
         CASE WHEN k % 10 = 0 THEN [12.0::DOUBLE, CAST(k % 3 AS DOUBLE)] ELSE [10.0::DOUBLE, 8.0::DOUBLE] END AS figsize,
         CASE WHEN k % 6 = 0 THEN '圖 ' || CAST(k AS VARCHAR) END AS set_title,
         CAST(NULL AS VARCHAR) AS set_xlabel, CAST(NULL AS VARCHAR) AS set_ylabel,
         CASE WHEN k % 4 >= 2 THEN strftime(ts - INTERVAL 300 MONTH, '%Y') || '01' END AS start_month,
         CASE WHEN k % 4 IN (1, 3) THEN strftime(ts - INTERVAL 300 MONTH, '%Y%m') END AS end_month,
         CASE WHEN k % 5 <> 0 THEN k % 25 END AS topn,
         CASE WHEN k % 7 = 0 THEN 'BUILDING' END AS industry,
         CAST(NULL AS VARCHAR) AS age_level
  FROM ev),
keyed AS (
  SELECT *, sha256('{' || concat_ws(',',
      CASE WHEN age_level IS NOT NULL THEN '"age_level":' || to_json(age_level) END,
      '"chart_type":' || to_json(chart_type),
      CASE WHEN end_month IS NOT NULL THEN '"end_month":' || to_json(end_month) END,
      CASE WHEN industry IS NOT NULL THEN '"industry":' || to_json(industry) END,
      '"params_figure":{' || concat_ws(',',
          CASE WHEN figsize IS NOT NULL THEN '"figsize":' || to_json(figsize) END,
          CASE WHEN set_title IS NOT NULL THEN '"set_title":' || to_json(set_title) END,
          CASE WHEN set_xlabel IS NOT NULL THEN '"set_xlabel":' || to_json(set_xlabel) END,
          CASE WHEN set_ylabel IS NOT NULL THEN '"set_ylabel":' || to_json(set_ylabel) END) || '}',
      '"params_json":{' || concat_ws(',',
          CASE WHEN value IS NOT NULL THEN '"value":' || to_json(value) END,
          CASE WHEN value2 IS NOT NULL THEN '"value2":' || to_json(value2) END,
          CASE WHEN x_axis IS NOT NULL THEN '"x_axis":' || to_json(x_axis) END,
          CASE WHEN y_axis IS NOT NULL THEN '"y_axis":' || to_json(y_axis) END) || '}',
      CASE WHEN start_month IS NOT NULL THEN '"start_month":' || to_json(start_month) END,
      CASE WHEN topn IS NOT NULL THEN '"topn":' || CAST(topn AS VARCHAR) END) || '}') AS cache_key
  FROM req),
checked AS (
  SELECT *, concat_ws(';',
      CASE WHEN chart_type NOT IN ('bar', 'line', 'pie', 'heatmap') OR chart_type IS NULL THEN 'INVALID_CHART_TYPE' END,
      CASE WHEN x_axis IS NULL OR x_axis NOT IN ('age_level', 'industry', 'ym') THEN 'INVALID_X_AXIS' END,
      CASE WHEN y_axis IS NOT NULL AND y_axis NOT IN ('age_level', 'industry', 'ym') THEN 'INVALID_Y_AXIS' END,
      CASE WHEN (value IS NOT NULL AND value NOT IN ('trans_count', 'trans_total'))
             OR (value2 IS NOT NULL AND value2 NOT IN ('trans_count', 'trans_total'))
             OR (value IS NULL AND chart_type IN ('bar', 'line', 'pie')) THEN 'INVALID_VALUE' END,
      CASE WHEN y_axis IS NOT NULL AND y_axis = x_axis THEN 'SAME_AXES' END,
      CASE WHEN chart_type = 'heatmap' AND y_axis IS NULL THEN 'HEATMAP_MISSING_y_axis' END,
      CASE WHEN chart_type = 'pie' AND y_axis IS NOT NULL THEN 'PIE_NO_NEED_y_axis' END,
      CASE WHEN chart_type = 'heatmap' AND (coalesce(value, '') <> 'trans_total' OR coalesce(value2, '') <> 'trans_count')
           THEN 'HEATMAP_METRICS' END,
      CASE WHEN topn IS NOT NULL AND topn <= 0 THEN 'INVALID_TOPN' END,
      CASE WHEN figsize IS NOT NULL AND len(figsize) <> 2 THEN 'FIGSIZE_LENGTH' END,
      CASE WHEN figsize IS NOT NULL AND len(figsize) = 2 AND (figsize[1] <= 0 OR figsize[2] <= 0) THEN 'FIGSIZE_NOT_POSITIVE' END,
      CASE WHEN start_month > end_month THEN 'INVALID_PERIOD' END
    ) AS error_codes
  FROM keyed),
acc AS (SELECT * FROM checked WHERE error_codes = ''),
firsts AS (SELECT cache_key, arg_min(id, (create_at, id)) AS first_id FROM acc GROUP BY cache_key)
"""


def _req(spark, sf_dir):
    return request_log(spark, sf_dir)


def _log(spark, sf_dir):
    """The request log as a stored table: derived from ``events`` once per
    session and state of its files, with the cache key and rule results
    computed at ingest."""
    return session_table(spark, "request_log", _log_version(spark, sf_dir),
                         lambda: R.validate(R.with_fingerprint(_req(spark, sf_dir))))


def _log_version(spark, sf_dir):
    return f"{sf_dir}@{data_version(read_table(spark, sf_dir, 'events'))}"


def _firsts(spark, sf_dir):
    """The first request of every accepted key, stored: the joins back to the
    log are then plain two-sided joins, which AQE can split at a hot key."""
    return session_table(spark, "request_firsts", _log_version(spark, sf_dir),
                         lambda: R.first_requests(_accepted(spark, sf_dir)))


def _accepted(spark, sf_dir):
    return _log(spark, sf_dir).where("accepted").drop("accepted", "error_codes")


@register("req_fingerprint", REQ_SQL + "SELECT id, cache_key FROM keyed")
def q_req_fingerprint(spark, sf_dir):
    """Cache key of every logged request."""
    return R.with_fingerprint(_req(spark, sf_dir)).select("id", "cache_key")


@register("req_validate", REQ_SQL + "SELECT id, chart_type, error_codes = '' AS accepted, error_codes FROM checked")
def q_req_validate(spark, sf_dir):
    """Accepted flag and broken rules per request."""
    return R.validate(_req(spark, sf_dir)).select("id", "chart_type", "accepted", "error_codes")


@register("req_hits", REQ_SQL + """
SELECT a.id, a.cache_key, (a.id <> f.first_id) AS cache_hit, f.first_id AS result_id
FROM acc a JOIN firsts f USING (cache_key)""")
def q_req_hits(spark, sf_dir):
    """R2: hit / miss of every accepted request and the result it maps to."""
    return R.mark_hits(_accepted(spark, sf_dir), firsts=_firsts(spark, sf_dir)).select(
        "id", "cache_key", "cache_hit", "result_id")


@register("req_results", REQ_SQL + """
SELECT f.first_id AS result_id, a.cache_key, a.chart_type, 'READY' AS status, a.create_by,
       a.create_at, s.last_at AS update_at, s.n_requests
FROM firsts f JOIN acc a ON a.id = f.first_id AND a.cache_key = f.cache_key
JOIN (SELECT cache_key, count(*) AS n_requests, max(create_at) AS last_at FROM acc GROUP BY cache_key) s
  ON s.cache_key = f.cache_key""")
def q_req_results(spark, sf_dir):
    """One result record per accepted key."""
    return R.result_records(_accepted(spark, sf_dir), firsts=_firsts(spark, sf_dir)).select(
        "result_id", "cache_key", "chart_type", "status", "create_by", "create_at", "update_at", "n_requests")


@register("req_with_result", REQ_SQL + """
SELECT a.id, f.first_id AS result_id, (a.id <> f.first_id) AS cache_hit, 'READY' AS status, s.n_requests
FROM acc a JOIN firsts f USING (cache_key)
JOIN (SELECT cache_key, count(*) AS n_requests FROM acc GROUP BY cache_key) s USING (cache_key)""")
def q_req_with_result(spark, sf_dir):
    """Requests joined to their result records."""
    acc, firsts = _accepted(spark, sf_dir), _firsts(spark, sf_dir)
    marked = R.mark_hits(acc, firsts=firsts)
    res = R.result_records(acc, firsts=firsts)
    return R.requests_with_results(marked, res).select("id", "result_id", "cache_hit", "status", "n_requests")


@register("req_lookup_first_pie", REQ_SQL + """
SELECT f.first_id AS result_id, a.cache_key, a.chart_type
FROM firsts f JOIN acc a ON a.id = f.first_id
WHERE a.chart_type = 'pie' ORDER BY f.first_id LIMIT 1""")
def q_req_lookup_first_pie(spark, sf_dir):
    """First result record whose chart type is 'pie'."""
    res = R.result_records(_accepted(spark, sf_dir))
    return R.first_match(res, "chart_type", "pie", order_by="result_id").select(
        "result_id", "cache_key", "chart_type")


@register("req_daily_volume", REQ_SQL + """
SELECT CAST(a.create_at AS DATE) AS day, a.chart_type, count(*) AS requests,
       CAST(sum(CASE WHEN a.id <> f.first_id THEN 1 ELSE 0 END) AS BIGINT) AS hits
FROM acc a JOIN firsts f USING (cache_key) GROUP BY 1, 2""")
def q_req_daily_volume(spark, sf_dir):
    """Requests and cache hits per day and chart type over the log."""
    m = R.mark_hits(_accepted(spark, sf_dir), firsts=_firsts(spark, sf_dir))
    return m.groupBy(F.to_date("create_at").alias("day"), "chart_type").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("cache_hit").cast("bigint")).alias("hits"))


# ---------------------------------------------------------------------------
# Serving: points of every accepted bar / line request in one job
# ---------------------------------------------------------------------------

SERVE_SQL = REQ_SQL + "," + FACT_LINES_SQL + """,
rq AS (SELECT DISTINCT cache_key, chart_type, x_axis, value, start_month, end_month, industry, age_level, topn
       FROM acc WHERE chart_type IN ('bar', 'line')),
agg AS (
  SELECT rq.cache_key, rq.chart_type, rq.x_axis, rq.value, rq.topn,
         CASE rq.x_axis WHEN 'ym' THEN f.ym WHEN 'industry' THEN f.industry ELSE f.age_level END AS x,
         CAST(sum(CASE rq.value WHEN 'trans_count' THEN f.trans_count ELSE f.trans_total END) AS BIGINT) AS raw_amount
  FROM rq JOIN fact f
    ON (rq.start_month IS NULL OR f.ym >= rq.start_month) AND (rq.end_month IS NULL OR f.ym <= rq.end_month)
   AND (rq.industry IS NULL OR f.industry = rq.industry) AND (rq.age_level IS NULL OR f.age_level = rq.age_level)
  GROUP BY 1, 2, 3, 4, 5, 6),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY cache_key ORDER BY
              CASE WHEN chart_type = 'bar' AND x_axis <> 'ym' THEN -raw_amount ELSE 0 END, x) AS BIGINT) AS pos
  FROM agg),
pts AS (
  SELECT cache_key, pos, x, raw_amount,
         round_even(CAST(raw_amount AS DOUBLE) / CASE value WHEN 'trans_count' THEN 10000000.0 ELSE 1000000000.0 END
                    * 100.0, 0) / 100.0 AS y
  FROM ranked WHERE x_axis = 'ym' OR pos <= least(greatest(coalesce(topn, 20), 1), 200))
SELECT cache_key, pos, x, raw_amount, y,
       round_even(y / nullif(sum(y) OVER (PARTITION BY cache_key), 0) * 100.0, 0) / 100.0 AS share
FROM pts"""


@register("req_serve_bar_line", SERVE_SQL)
def q_req_serve_bar_line(spark, sf_dir):
    """Points of every accepted bar / line request of the log, from one
    rolled-up lookup of the fact and an equi-join."""
    from ..sources.tables import fact_table
    from .serving import serve_sum_charts, stored_lookup
    fact = fact_table(spark, sf_dir)
    return serve_sum_charts(fact, _accepted(spark, sf_dir), stored_lookup(spark, fact, sf_dir))


SERVE_PIE_SQL = REQ_SQL + "," + FACT_LINES_SQL + """,
rq AS (SELECT DISTINCT cache_key, x_axis, value, start_month, end_month, industry, age_level, topn
       FROM acc WHERE chart_type = 'pie'),
g AS (
  SELECT rq.cache_key, rq.x_axis, rq.topn,
         CASE rq.x_axis WHEN 'ym' THEN f.ym WHEN 'industry' THEN f.industry ELSE f.age_level END AS x,
         sum(CASE rq.value WHEN 'trans_count' THEN f.trans_count ELSE f.trans_total END) AS group_amount
  FROM rq JOIN fact f
    ON (rq.start_month IS NULL OR f.ym >= rq.start_month) AND (rq.end_month IS NULL OR f.ym <= rq.end_month)
   AND (rq.industry IS NULL OR f.industry = rq.industry) AND (rq.age_level IS NULL OR f.age_level = rq.age_level)
  GROUP BY 1, 2, 3, 4),
s AS (SELECT cache_key, x_axis, topn, x,
             round(CAST(group_amount AS DOUBLE) / nullif(CAST(sum(group_amount) OVER (PARTITION BY cache_key) AS DOUBLE), 0) * 100.0, 0) AS pct
      FROM g),
u AS (SELECT cache_key, x_axis, topn, CASE WHEN pct < 10 THEN '其他' ELSE x END AS x, sum(pct) AS amount
      FROM s GROUP BY 1, 2, 3, 4),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cache_key ORDER BY
              CASE WHEN x_axis = 'ym' THEN 0.0 ELSE -amount END ASC NULLS LAST, x) AS BIGINT) AS pos FROM u)
SELECT cache_key, pos, CASE WHEN amount >= 0.10 THEN x ELSE '其他' END AS x, amount
FROM r WHERE x_axis = 'ym' OR pos <= least(greatest(coalesce(topn, 20), 1), 200)"""


@register("req_serve_pie", SERVE_PIE_SQL)
def q_req_serve_pie(spark, sf_dir):
    """Slices of every accepted pie request of the log."""
    from ..sources.tables import fact_table
    from .serving import serve_pie_charts, stored_lookup
    fact = fact_table(spark, sf_dir)
    return serve_pie_charts(fact, _accepted(spark, sf_dir), stored_lookup(spark, fact, sf_dir))


SERVE_HEATMAP_SQL = REQ_SQL + "," + FACT_LINES_SQL + """,
rq AS (SELECT DISTINCT cache_key, x_axis, y_axis, start_month, end_month, industry, age_level
       FROM acc WHERE chart_type = 'heatmap'),
g AS (
  SELECT rq.cache_key, rq.x_axis, rq.y_axis,
         CASE rq.x_axis WHEN 'ym' THEN f.ym WHEN 'industry' THEN f.industry ELSE f.age_level END AS x,
         CASE rq.y_axis WHEN 'ym' THEN f.ym WHEN 'industry' THEN f.industry ELSE f.age_level END AS y,
         sum(f.trans_total) AS num, sum(f.trans_count) AS den
  FROM rq JOIN fact f
    ON (rq.start_month IS NULL OR f.ym >= rq.start_month) AND (rq.end_month IS NULL OR f.ym <= rq.end_month)
   AND (rq.industry IS NULL OR f.industry = rq.industry) AND (rq.age_level IS NULL OR f.age_level = rq.age_level)
  GROUP BY 1, 2, 3, 4, 5)
SELECT cache_key,
       CAST(row_number() OVER (PARTITION BY cache_key ORDER BY
            CASE WHEN x_axis = 'age_level' OR y_axis = 'age_level' THEN y ELSE x END,
            CASE WHEN x_axis = 'age_level' OR y_axis = 'age_level' THEN x ELSE y END) AS BIGINT) AS pos,
       x, y, round(CAST(num AS DOUBLE) / CAST(nullif(den, 0) AS DOUBLE), 4) AS amount
FROM g"""


@register("req_serve_heatmap", SERVE_HEATMAP_SQL)
def q_req_serve_heatmap(spark, sf_dir):
    """Cells of every accepted heatmap request of the log."""
    from ..sources.tables import fact_table
    from .serving import serve_heatmap_charts, stored_lookup
    fact = fact_table(spark, sf_dir)
    return serve_heatmap_charts(fact, _accepted(spark, sf_dir), lookup=stored_lookup(spark, fact, sf_dir))
