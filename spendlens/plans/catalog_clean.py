"""Cleaning, source and sink queries (registered into the catalog).

All of them start from the dirty extract derived from the driver tables
(``fixtures.dirty_extract``); the source queries first write it in a file
layout under the shared checkpoint folder and read it back.
"""
from __future__ import annotations


from ..config import shared_path, write_table
from ..operators import clean as C
from ..sources.sinks import append_new_rows, read_fact
from . import etl
from .catalog import register, with_fact
from .fixtures import DIRTY_SQL_CTES, RAW_HEADERS, dirty_extract

NUM_RX = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _parse_sql(c: str, sep: str) -> str:
    t = f"trim(replace({c}, ',', '{sep}'))"
    return (f"CASE WHEN regexp_full_match({t}, '{NUM_RX}') AND isfinite(TRY_CAST({t} AS DOUBLE)) "
            f"THEN CAST({t} AS DOUBLE) END")


def _mode_sql(c: str) -> str:
    return (f"(SELECT {c} FROM parsed WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


def clean_sql(sep: str = "") -> str:
    """Oracle of the whole cleaning chain over the dirty extract."""
    return with_fact(
        """SELECT ym, nation, industry, age_level,
                  CAST(trunc(trans_count) AS BIGINT) AS trans_count,
                  CAST(trunc(trans_total) AS BIGINT) AS trans_total
           FROM (SELECT DISTINCT * FROM filled)""",
        *DIRTY_SQL_CTES,
        f"""parsed AS (SELECT ym, nation, industry, age_level,
                  {_parse_sql('count_txt', sep)} AS trans_count,
                  {_parse_sql('total_txt', sep)} AS trans_total FROM raw)""",
        f"""fills AS (SELECT median(trans_count) AS f_count, median(trans_total) AS f_total,
                  {_mode_sql('ym')} AS f_ym, {_mode_sql('nation')} AS f_nation,
                  {_mode_sql('industry')} AS f_industry, {_mode_sql('age_level')} AS f_age FROM parsed)""",
        """filled AS (SELECT coalesce(p.ym, f.f_ym) AS ym, coalesce(p.nation, f.f_nation) AS nation,
                  coalesce(p.industry, f.f_industry) AS industry, coalesce(p.age_level, f.f_age) AS age_level,
                  coalesce(p.trans_count, f.f_count) AS trans_count,
                  coalesce(p.trans_total, f.f_total) AS trans_total
           FROM parsed p, fills f)""")


CLEAN_SQL = clean_sql("")


def _clean(spark, sf_dir, thousands="strip"):
    return C.clean_extract(dirty_extract(spark, sf_dir), thousands=thousands)


@register("clean_pipeline", CLEAN_SQL)
def q_clean_pipeline(spark, sf_dir):
    """C1-C11 over the dirty extract, thousands separators removed."""
    return _clean(spark, sf_dir)


@register("clean_pipeline_literal_comma", clean_sql(" "))
def q_clean_literal(spark, sf_dir):
    """C1-C11 with the literal separator rule (',' -> ' ', so '1,234' is
    unparsable and gets the median)."""
    return _clean(spark, sf_dir, thousands="space")


@register("clean_missing_profile", with_fact(
    """SELECT 'ym' AS "column", avg(CASE WHEN ym IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS missing_ratio FROM parsed
       UNION ALL SELECT 'nation', avg(CASE WHEN nation IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM parsed
       UNION ALL SELECT 'industry', avg(CASE WHEN industry IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM parsed
       UNION ALL SELECT 'age_level', avg(CASE WHEN age_level IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM parsed
       UNION ALL SELECT 'trans_count', avg(CASE WHEN trans_count IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM parsed
       UNION ALL SELECT 'trans_total', avg(CASE WHEN trans_total IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM parsed""",
    *DIRTY_SQL_CTES,
    f"""parsed AS (SELECT ym, nation, industry, age_level,
              {_parse_sql('count_txt', '')} AS trans_count, {_parse_sql('total_txt', '')} AS trans_total FROM raw)"""))
def q_clean_missing_profile(spark, sf_dir):
    """Missing ratio per column after number parsing."""
    raw = dirty_extract(spark, sf_dir)
    parsed = C.parse_metrics(C.project(C.rename_headers(raw)))
    return C.missing_profile(parsed)


@register("clean_fill_values", with_fact(
    """SELECT median(trans_count) AS trans_count, median(trans_total) AS trans_total,
              {ym} AS ym, {ind} AS industry, {age} AS age_level FROM parsed""".format(
        ym=_mode_sql("ym"), ind=_mode_sql("industry"), age=_mode_sql("age_level")),
    *DIRTY_SQL_CTES,
    f"""parsed AS (SELECT ym, nation, industry, age_level,
              {_parse_sql('count_txt', '')} AS trans_count, {_parse_sql('total_txt', '')} AS trans_total FROM raw)"""))
def q_clean_fill_values(spark, sf_dir):
    """The imputation values (exact medians, smallest-on-tie modes)
    of the columns that have missing values, as one row."""
    parsed = write_table(C.parsed_extract(dirty_extract(spark, sf_dir)), shared_path(spark, "parsed-extract"))
    return C.fill_values(parsed, ["trans_count", "trans_total"], ["ym", "industry", "age_level"])


@register("clean_duplicate_stats", with_fact(
    """SELECT CAST(count(*) AS BIGINT) AS rows_before,
              CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS BIGINT) AS rows_after,
              CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS BIGINT) AS duplicates
       FROM r""",
    *DIRTY_SQL_CTES,
    "r AS (SELECT ym, nation, industry, age_level, count_txt, total_txt FROM raw)"))
def q_clean_duplicate_stats(spark, sf_dir):
    """Rows before / after exact de-duplication of the raw extract."""
    return C.duplicate_stats(dirty_extract(spark, sf_dir))


# ---------------------------------------------------------------------------
# Sources: write the dirty extract in a layout, read it back, clean (S1, S2a-d)
# ---------------------------------------------------------------------------

def _roundtrip(layout: str):
    def run(spark, sf_dir):
        path = shared_path(spark, f"extract-{layout}")
        etl.write_extract(dirty_extract(spark, sf_dir, keep_ids=True), layout, path, RAW_HEADERS)
        return C.clean_extract(etl.read_extract(spark, layout, path))
    run.__doc__ = f"Dirty extract written as {layout}, read back and cleaned."
    return run


for _layout, _name in (("csv", "src_csv_clean"), ("lines", "src_jsonl_clean"),
                       ("array", "src_json_array_clean"), ("wrapped", "src_json_wrapped_clean"),
                       ("keyed", "src_json_keyed_clean")):
    register(_name, CLEAN_SQL)(_roundtrip(_layout))


# ---------------------------------------------------------------------------
# Sink / ETL
# ---------------------------------------------------------------------------

@register("sink_append_idempotent", CLEAN_SQL)
def q_sink_append(spark, sf_dir):
    """Append the cleaned rows twice; the second append adds nothing."""
    path = shared_path(spark, "fact-table")
    clean = _clean(spark, sf_dir)
    append_new_rows(spark, clean, path)
    append_new_rows(spark, clean, path)
    return read_fact(spark, path)


@register("etl_json_rerun", CLEAN_SQL)
def q_etl_json_rerun(spark, sf_dir):
    """Run the JSON ETL twice into one table (auto-detected layout)."""
    src = shared_path(spark, "extract-array")
    etl.write_extract(dirty_extract(spark, sf_dir, keep_ids=True), "array", src, RAW_HEADERS)
    table = shared_path(spark, "fact-table")
    etl.run_etl(spark, "json", src, table)
    etl.run_etl(spark, "json", src, table)
    return read_fact(spark, table)


# ---------------------------------------------------------------------------
# Streaming ingest (row-level cleaning, no imputation)
# ---------------------------------------------------------------------------

STREAM_SQL = with_fact(
    """SELECT DISTINCT ym, nation, industry, age_level,
              CAST(trunc(trans_count) AS BIGINT) AS trans_count,
              CAST(trunc(trans_total) AS BIGINT) AS trans_total
       FROM parsed""",
    *DIRTY_SQL_CTES,
    f"""parsed AS (SELECT ym, nation, industry, age_level,
              {_parse_sql('count_txt', '')} AS trans_count, {_parse_sql('total_txt', '')} AS trans_total FROM raw)""")


@register("stream_csv_ingest", STREAM_SQL)
def q_stream_csv_ingest(spark, sf_dir):
    """Structured Streaming ingest: the dirty extract as CSV files, picked up
    by an availableNow file stream (several micro-batches), cleaned row by
    row and appended idempotently; missing values stay NULL."""
    from ..streaming import ingest_stream
    src = shared_path(spark, "stream-src")
    etl.write_extract(dirty_extract(spark, sf_dir, keep_ids=True), "csv", src, RAW_HEADERS)
    table = shared_path(spark, "stream-table")
    q = ingest_stream(spark, src, table, shared_path(spark, "stream-ckpt"), max_files_per_trigger=2)
    q.awaitTermination()
    return read_fact(spark, table)
