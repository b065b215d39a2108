"""Queries over streams of chart requests and of their statuses (§2.11, R1, R2, R4),
and over a fact that grows by appends (S4, A1-A7, C5, C6)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import shared_path, write_table
from ..operators import clean as C
from ..operators.monthly import fill_values_by_month
from ..schema import METRIC_COLUMNS, TEXT_COLUMNS
from ..sources.sinks import append_new_rows, read_fact
from ..sources.tables import fact_table, read_table
from ..streaming import ingest_stream, requests as S
from .catalog import REGISTRY, register
from .catalog_requests import REQ_SQL, SERVE_SQL, _accepted, _req
from .etl import write_extract
from .fixtures import RAW_HEADERS, dirty_extract
from .serving import maintained_lookup, serve_sum_charts


def _deliver(rows, path: str) -> None:
    """Writes rows as files that arrive out of order: newest first, then some of them again."""
    late = F.pmod(F.xxhash64("id"), F.lit(7))
    rows.where(late < 3).repartition(3, "id").write.mode("append").parquet(path)
    rows.where(late >= 3).repartition(3, "id").write.mode("append").parquet(path)
    # The one file is written by a task of its own; what comes before stays parallel.
    rows.where(late == 0).repartition(1).write.mode("append").parquet(path)


@register("stream_req_hits", REQ_SQL + """
SELECT a.id, a.cache_key, (a.id <> f.first_id) AS cache_hit, f.first_id AS result_id
FROM acc a JOIN firsts f USING (cache_key)""")
def q_stream_req_hits(spark, sf_dir):
    """R1, R2 on a stream: requests come in micro-batches, out of order and some
    of them twice; hits and results equal those of the whole log."""
    src, log, firsts = (shared_path(spark, f"stream-{k}") for k in ("requests", "log", "firsts"))
    requests = write_table(_req(spark, sf_dir), shared_path(spark, "sent-requests"))
    _deliver(requests, src)
    stream = S.accepted_requests(S.request_files(spark, src, requests.schema, files_per_batch=2))
    for query in (S.track_firsts(stream, firsts, shared_path(spark, "stream-ckpt")), S.append_log(stream, log, shared_path(spark, "stream-ckpt"))):
        query.awaitTermination()
    return S.marked_log(spark, log, firsts).select("id", "cache_key", "cache_hit", "result_id")


def _status_events(spark, sf_dir):
    """What a chart service reports about its results: a result is pending from its
    request on; it is ready two minutes later, or has failed, or is never answered."""
    # Stored: both kinds of events come from it, and every delivery reads them.
    accepted = write_table(S.accepted_requests(_req(spark, sf_dir)).select("id", "cache_key", "create_at"), shared_path(spark, "accepted-requests"))
    end = F.when(F.col("id") % 5 == 0, "FAILED").when(F.col("id") % 5 <= 3, "READY")
    ended = accepted.where(end.isNotNull()).select("id", "cache_key", end.alias("status"), (F.col("create_at") + F.expr("INTERVAL 2 MINUTES")).alias("at"))
    return accepted.select("id", "cache_key", F.lit("PENDING").alias("status"), F.col("create_at").alias("at")).unionByName(ended)


@register("req_status_timeline", REQ_SQL + """,
said AS (
  SELECT cache_key, 'PENDING' AS status, create_at AS said_at FROM acc
  UNION ALL
  SELECT cache_key, CASE WHEN id % 5 = 0 THEN 'FAILED' ELSE 'READY' END, create_at + INTERVAL 2 MINUTE FROM acc WHERE id % 5 <= 3)
SELECT cache_key, arg_max(status, (said_at, CASE status WHEN 'PENDING' THEN 0 WHEN 'READY' THEN 1 ELSE 2 END)) AS status,
       strftime(max(said_at), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM said GROUP BY cache_key""")
def q_req_status_timeline(spark, sf_dir):
    """R4 over time: statuses PENDING, READY and FAILED reported out of order and
    partly twice; the latest of each key stands."""
    src, path = shared_path(spark, "stream-status"), shared_path(spark, "stream-latest")
    events = _status_events(spark, sf_dir)
    _deliver(events, src)
    S.track_status(S.request_files(spark, src, events.schema, files_per_batch=2), path, shared_path(spark, "stream-ckpt")).awaitTermination()
    return S.statuses(spark, path).select("cache_key", "status", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


# ---------------------------------------------------------------------------
# A growing fact
# ---------------------------------------------------------------------------

@register("serve_after_append", SERVE_SQL.replace("rq AS (", "whole AS (SELECT DISTINCT ym, nation, industry, age_level, trans_count, trans_total FROM fact),\nrq AS (", 1)
          .replace("JOIN fact f", "JOIN whole f"))
def q_serve_after_append(spark, sf_dir):
    """Whole fact rows are appended in three parts, the last into months that exist;
    after each the stored lookup is brought up to date, and requests are served from it."""
    path, state = shared_path(spark, "growing-fact"), shared_path(spark, "growing-lookup")
    fact = fact_table(spark, sf_dir)
    late = (F.col("ym").substr(5, 2) == "03") & (F.col("trans_total") % 2 == 0)
    for part in (fact.where((F.col("ym") < "199801") & ~late), fact.where((F.col("ym") >= "199801") & ~late), fact.where(late)):
        append_new_rows(spark, part, path)
        lookup, _ = maintained_lookup(spark, path, state)
    return serve_sum_charts(read_fact(spark, path), _accepted(spark, sf_dir), lookup)


_PARSED = ", ".join([f"{c} string" for c in TEXT_COLUMNS] + [f"{c} double" for c in METRIC_COLUMNS])


@register("clean_fill_after_append", REGISTRY["clean_fill_values"].sql)
def q_clean_fill_after_append(spark, sf_dir):
    """A parsed extract grows by months; the fill values after the last
    append come from the statistics stored by month."""
    path, state = shared_path(spark, "growing-extract"), shared_path(spark, "growing-statistics")
    parsed = C.parsed_extract(dirty_extract(spark, sf_dir)).select(*TEXT_COLUMNS, *METRIC_COLUMNS)
    for part in (F.coalesce(F.col("ym") < "199701", F.lit(True)), F.col("ym") >= "199701"):
        parsed.where(part).hint("rebalance", "ym").write.mode("append").partitionBy("ym").parquet(path)
        fills, _ = fill_values_by_month(spark, path, state, _PARSED)
    return spark.createDataFrame([tuple(fills[c] for c in ("trans_count", "trans_total", "ym", "industry", "age_level"))],
                                 "trans_count double, trans_total double, ym string, industry string, age_level string")


@register("stream_csv_mixed_headers", REGISTRY["stream_csv_ingest"].sql)
def q_stream_csv_mixed_headers(spark, sf_dir):
    """§2.11: streamed files whose headers name their columns in different orders."""
    src, table = shared_path(spark, "stream-orders"), shared_path(spark, "stream-table")
    rows = dirty_extract(spark, sf_dir, keep_ids=True)
    for k, headers in enumerate((RAW_HEADERS, RAW_HEADERS[::-1])):
        write_extract(rows.where(F.col("l_orderkey") % 2 == k), "csv", f"{src}/{k}", headers)
    ingest_stream(spark, f"{src}/*", table, shared_path(spark, "stream-ckpt"), max_files_per_trigger=4).awaitTermination()
    return read_fact(spark, table)


@register("sink_append_dirty_months", """
WITH lines AS (
  SELECT CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y%m') WHEN 1 THEN strftime(ts, '%Y-%m') WHEN 2 THEN NULL
                           WHEN 3 THEN 'unknown' ELSE strftime(ts, '%Y%m') END AS ym, event_type, user_id
  FROM events)
SELECT DISTINCT ym, CAST(NULL AS VARCHAR) AS nation, event_type AS industry, CAST(NULL AS VARCHAR) AS age_level,
       user_id % 50 AS trans_count, user_id AS trans_total
FROM lines""")
def q_sink_append_dirty_months(spark, sf_dir):
    """Rows whose month is missing or no month at all share one folder, keep
    their text, and are appended once."""
    month = F.date_format("ts", "yyyyMM")
    ym = (F.when(F.col("event_id") % 5 == 1, F.date_format("ts", "yyyy-MM")).when(F.col("event_id") % 5 == 2, F.lit(None))
          .when(F.col("event_id") % 5 == 3, F.lit("unknown")).otherwise(month))
    none = F.lit(None).cast("string")
    rows = read_table(spark, sf_dir, "events").select(
        ym.alias("ym"), none.alias("nation"), F.col("event_type").alias("industry"), none.alias("age_level"),
        (F.col("user_id") % 50).cast("bigint").alias("trans_count"), F.col("user_id").cast("bigint").alias("trans_total"))
    path = shared_path(spark, "dirty-months")
    append_new_rows(spark, rows.where("trans_total % 2 = 0"), path)
    append_new_rows(spark, rows, path)
    return read_fact(spark, path)
