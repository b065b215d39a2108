"""Inputs derived from the driver tables for the cleaning and request-log
operators: a dirty raw extract (source headers, text values, blanks, junk,
thousands separators, missing values, exact copies) and a log of chart
requests.  Both are deterministic functions of the tables, so the DuckDB
oracles rebuild them with the same rules (see ``catalog_clean`` /
``catalog_requests``)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import HEADER_MAP
from ..sources.tables import fact_lines, read_table, widen

RAW_HEADERS = list(HEADER_MAP)  # source header order


def _rid():
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def dirty_extract(spark: SparkSession, sf_dir: str, keep_ids: bool = False) -> DataFrame:
    """The fact as a raw extract with defects.

    Rules on the line id ``rid = l_orderkey * 8 + l_linenumber``:
    month missing when rid % 31 = 0; industry missing when rid % 19 = 0; age
    band missing when rid % 23 = 0; count missing when rid % 11 = 0, 'n/a'
    when rid % 13 = 0, padded with spaces when rid % 7 = 0; total blank when
    rid % 17 = 0, with a thousands separator when rid % 3 = 0; every row with
    rid % 29 = 0 appears twice.  ``keep_ids`` keeps the line key and ``copy``.
    """
    lines = fact_lines(spark, sf_dir)
    rid = _rid()
    cnt = F.col("trans_count").cast("string")
    tot = F.col("trans_total")
    base = lines.select(
        rid.alias("rid"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(rid % 31 == 0, F.lit(None)).otherwise(F.col("ym")).alias("年月"),
        F.col("nation").alias("地區"),
        F.when(rid % 19 == 0, F.lit(None)).otherwise(F.col("industry")).alias("信用卡產業別"),
        F.when(rid % 23 == 0, F.lit(None)).otherwise(F.col("age_level")).alias("年齡層"),
        F.when(rid % 11 == 0, F.lit(None))
         .when(rid % 13 == 0, F.lit("n/a"))
         .when(rid % 7 == 0, F.concat(F.lit(" "), cnt, F.lit(" ")))
         .otherwise(cnt).alias("信用卡交易筆數"),
        F.when(rid % 17 == 0, F.lit(""))
         .when(rid % 3 == 0, F.format_number(tot, 0))
         .otherwise(tot.cast("string")).alias("信用卡交易金額[新臺幣]"),
    )
    copies = F.explode(F.when(F.col("rid") % 29 == 0, F.array(F.lit(0), F.lit(1)))
                       .otherwise(F.array(F.lit(0))))
    out = base.select("*", copies.alias("copy"))
    return out if keep_ids else out.select(*RAW_HEADERS)


DIRTY_SQL_CTES = (
    """dirty AS (
  SELECT l_orderkey * 8 + l_linenumber AS rid,
         CASE WHEN (l_orderkey * 8 + l_linenumber) % 31 = 0 THEN NULL ELSE ym END AS ym,
         nation,
         CASE WHEN (l_orderkey * 8 + l_linenumber) % 19 = 0 THEN NULL ELSE industry END AS industry,
         CASE WHEN (l_orderkey * 8 + l_linenumber) % 23 = 0 THEN NULL ELSE age_level END AS age_level,
         CASE WHEN (l_orderkey * 8 + l_linenumber) % 11 = 0 THEN NULL
              WHEN (l_orderkey * 8 + l_linenumber) % 13 = 0 THEN 'n/a'
              WHEN (l_orderkey * 8 + l_linenumber) % 7 = 0 THEN ' ' || CAST(trans_count AS VARCHAR) || ' '
              ELSE CAST(trans_count AS VARCHAR) END AS count_txt,
         CASE WHEN (l_orderkey * 8 + l_linenumber) % 17 = 0 THEN ''
              WHEN (l_orderkey * 8 + l_linenumber) % 3 = 0 THEN format('{:,}', trans_total)
              ELSE CAST(trans_total AS VARCHAR) END AS total_txt
  FROM fact_lines)""",
    """raw AS (SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE rid % 29 = 0)""",
)


# ---------------------------------------------------------------------------
# Request log derived from ``events``
# ---------------------------------------------------------------------------

def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart requests derived from the event stream.

    id = event_id, create_at = ts, create_by = user_id; chart type from the
    event type (click bar, view line, purchase pie, signup heatmap, error an
    unknown 'scatter'); k = props.k drives the parameters: x axis
    dims[user_id % 3], y axis none when k % 3 = 0 else dims[(user_id + k % 4) % 3]
    (heatmaps always get one), value metrics[k % 2], value2 trans_count for
    heatmaps, topn k % 25 (none when k % 5 = 0), months from the event month
    shifted back 25 years (so they fall inside the fact's months)
    with k % 4 deciding which sides are set, industry for k % 7 = 0, a title
    for k % 6 = 0, figsize [10, 8] except [12, k % 3] when k % 10 = 0.
    """
    ev = widen(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"))
    k = F.get_json_object("props", "$.k").try_cast("int")
    dims = F.array(F.lit("ym"), F.lit("industry"), F.lit("age_level"))
    metrics = F.array(F.lit("trans_count"), F.lit("trans_total"))
    chart = (F.when(F.col("event_type") == "click", "bar").when(F.col("event_type") == "view", "line")
             .when(F.col("event_type") == "purchase", "pie").when(F.col("event_type") == "signup", "heatmap")
             .otherwise("scatter"))
    r = ev.select("event_id", "ts", "user_id", chart.alias("chart_type"), k.alias("k"))
    x_axis = dims[F.col("user_id") % 3]
    y_any = dims[(F.col("user_id") + F.col("k") % 4) % 3]
    y_axis = (F.when(F.col("chart_type") == "heatmap", dims[(F.col("user_id") + 1) % 3])
              .when(F.col("k") % 3 == 0, F.lit(None)).otherwise(y_any))
    month = F.date_format(F.add_months("ts", -300), "yyyyMM")  # 25 years back: inside the fact's range
    start = F.when(F.col("k") % 4 >= 2, F.concat(F.substring(month, 1, 4), F.lit("01")))
    end = F.when(F.col("k") % 4 == 1, month).when(F.col("k") % 4 == 3, month)
    figsize = F.when(F.col("k") % 10 == 0, F.array(F.lit(12.0), (F.col("k") % 3).cast("double"))) \
               .otherwise(F.array(F.lit(10.0), F.lit(8.0)))
    return r.select(
        F.col("event_id").alias("id"),
        "chart_type",
        F.struct(x_axis.alias("x_axis"), y_axis.alias("y_axis"),
                 metrics[F.col("k") % 2].alias("value"),
                 F.when(F.col("chart_type") == "heatmap", F.lit("trans_count")).alias("value2")).alias("params"),
        F.struct(figsize.alias("figsize"),
                 F.when(F.col("k") % 6 == 0, F.concat(F.lit("圖 "), F.col("k").cast("string"))).alias("set_title"),
                 F.lit(None).cast("string").alias("set_xlabel"),
                 F.lit(None).cast("string").alias("set_ylabel")).alias("figure"),
        F.struct(start.alias("start_month"), end.alias("end_month"),
                 F.when(F.col("k") % 5 != 0, (F.col("k") % 25)).cast("int").alias("topn"),
                 F.when(F.col("k") % 7 == 0, F.lit("BUILDING")).alias("industry"),
                 F.lit(None).cast("string").alias("age_level")).alias("filters"),
        F.col("user_id").alias("create_by"),
        F.col("ts").alias("create_at"),
    )
