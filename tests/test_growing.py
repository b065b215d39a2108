"""Streams of requests, state kept by month, metadata answers, dirty months."""
import math
import os

import pytest
from pyspark.sql import functions as F

from spendlens.config import data_version, path_mark, shared_path
from spendlens.operators import clean, monthly
from spendlens.operators.quantiles import exact_medians
from spendlens.plans.serving import maintained_lookup, rollup_lookup
from spendlens.sources import sinks, tables
from spendlens.streaming import requests as S

ROWS = [(f"2024{m:02d}", "n", ind, age, m, 10 * m + k) for m in (1, 2, 3) for k, (ind, age) in enumerate((("a", "x"), ("b", "x"), ("a", "y")))]


def jobs(spark):
    """Ids of the jobs of this application so far, as the status store has them."""
    return spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


# -- streams ---------------------------------------------------------------------

SCHEMA = "id long, cache_key string, create_at timestamp"


def at(spark, rows):
    return spark.createDataFrame(rows, "id long, cache_key string, t long").select("id", "cache_key", F.timestamp_seconds("t").alias("create_at"))


def run_stream(spark, src, log, firsts, ckpt):
    stream = S.request_files(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    S.track_firsts(stream, firsts, f"{ckpt}/firsts").awaitTermination()
    S.append_log(stream, log, f"{ckpt}/log").awaitTermination()
    return {r["id"]: (r["cache_key"], r["cache_hit"], r["result_id"]) for r in S.marked_log(spark, log, firsts).collect()}


def test_late_and_repeated_requests(spark):
    src, log, firsts, ckpt = (shared_path(spark, f"t-{k}") for k in ("src", "log", "firsts", "ckpt"))
    day = 86_400
    at(spark, [(2, "k", 2 * day), (3, "k", 3 * day), (5, "m", day)]).coalesce(1).write.parquet(f"{src}/p=1")
    stream_src = f"{src}/*"
    assert run_stream(spark, stream_src, log, firsts, ckpt) == {2: ("k", False, 2), 3: ("k", True, 2), 5: ("m", False, 5)}
    # The first request of k comes late, together with a repeated one.
    at(spark, [(1, "k", day), (3, "k", 3 * day)]).coalesce(1).write.parquet(f"{src}/p=2")
    want = {1: ("k", False, 1), 2: ("k", True, 1), 3: ("k", True, 1), 5: ("m", False, 5)}
    assert run_stream(spark, stream_src, log, firsts, ckpt) == want
    # Everything again, as after a lost checkpoint: nothing changes.
    assert run_stream(spark, stream_src, log, firsts, shared_path(spark, "t-ckpt")) == want
    assert spark.read.parquet(log).count() == 4
    small = S.compact(spark, firsts, shared_path(spark, "t-compact"))
    assert same(S.firsts(spark, small), S.firsts(spark, firsts))


def test_requests_of_one_time_and_without_time(spark):
    src, log, firsts, ckpt = (shared_path(spark, f"t-{k}") for k in ("src", "log", "firsts", "ckpt"))
    at(spark, [(9, "k", 5), (4, "k", 5), (7, "n", None), (7, "n", None)]).coalesce(1).write.parquet(f"{src}/p=1")
    for _ in range(2):
        found = run_stream(spark, f"{src}/*", log, firsts, ckpt)
        assert found[9] == ("k", True, 4) and found[4] == ("k", False, 4) and spark.read.parquet(log).count() == 3
        ckpt = shared_path(spark, "t-ckpt")


def test_status_at_one_time_and_late(spark):
    rows = [("a", "PENDING", 1), ("a", "READY", 3), ("a", "PENDING", 2), ("b", "FAILED", 5), ("b", "READY", 5), ("c", "PENDING", 9), ("c", "PENDING", 9)]
    events = spark.createDataFrame(rows, "cache_key string, status string, t long").select("cache_key", "status", F.timestamp_seconds("t").alias("at"))
    want = [("a", "READY"), ("b", "FAILED"), ("c", "PENDING")]
    assert sorted((r["cache_key"], r["status"]) for r in S.latest_status(events).collect()) == want
    src, path, ckpt = (shared_path(spark, f"t-{k}") for k in ("src", "status", "ckpt"))
    events.repartition(4).write.parquet(src)
    S.track_status(S.request_files(spark, src, events.schema, files_per_batch=1), path, ckpt).awaitTermination()
    assert sorted((r["cache_key"], r["status"]) for r in S.statuses(spark, path).collect()) == want


def test_nothing_streamed_yet(spark):
    path = shared_path(spark, "t-none")
    assert S.firsts(spark, path).count() == 0 and S.statuses(spark, path).count() == 0


# -- state by month ----------------------------------------------------------------

def test_lookup_after_appends(spark, make_fact):
    path, state = shared_path(spark, "t-fact"), shared_path(spark, "t-lookup")
    sinks.append_new_rows(spark, make_fact(ROWS), path)
    lookup, touched = maintained_lookup(spark, path, state)
    assert touched == ["202401", "202402", "202403"] and same(lookup, rollup_lookup(sinks.read_fact(spark, path)))
    assert maintained_lookup(spark, path, state)[1] == []
    sinks.append_new_rows(spark, make_fact([("202402", "n", "c", "x", 5, 7), ("202404", "n", "a", "x", 1, 1)]), path)
    lookup, touched = maintained_lookup(spark, path, state)
    assert touched == ["202402", "202404"] and same(lookup, rollup_lookup(sinks.read_fact(spark, path)))
    # Replayed rows touch nothing.
    sinks.append_new_rows(spark, make_fact(ROWS), path)
    assert maintained_lookup(spark, path, state)[1] == []


def test_refresh_reads_touched_months_only(spark, make_fact):
    path, state = shared_path(spark, "t-fact"), shared_path(spark, "t-state")
    sinks.append_new_rows(spark, make_fact(ROWS), path)
    maintained_lookup(spark, path, state)
    sinks.append_new_rows(spark, make_fact([("202402", "n", "z", "z", 5, 7)]), path)
    plans = []

    def build(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        assert {r["ym"] for r in rows.collect()} == {"202402"}
        return rollup_lookup(rows)

    monthly.refresh_by_month(spark, path, state, build)
    assert len(plans) == 1 and "PartitionFilters: [" in plans[0] and "202402" in plans[0]


def test_fill_values_by_month(spark):
    path, state = shared_path(spark, "t-extract"), shared_path(spark, "t-stats")
    schema = "ym string, nation string, industry string, age_level string, trans_count double, trans_total double"
    parts = [[("202401", "n", "a", None, float(k % 17), float(k * k % 1013)) for k in range(500)] + [(None, None, "b", "x", None, math.nan)] * 3,
             [("202402", "m", "b", "y", float(k), None) for k in range(700)], [("202401", "n", "b", "y", 3.0, 4.0)] * 9]
    rows = []
    for k, part in enumerate(parts):
        rows += part
        spark.createDataFrame(part, schema).write.mode("append").partitionBy("ym").parquet(path)
        fills, touched = monthly.fill_values_by_month(spark, path, state, schema)
        df = spark.createDataFrame(rows, schema)
        want = {**exact_medians(df, ["trans_count", "trans_total"]), **clean.text_modes(df, ["ym", "nation", "industry", "age_level"])}
        assert fills == want
        assert touched == [["202401", None], ["202402"], ["202401"]][k]


def test_fill_values_without_numbers(spark):
    path, state = shared_path(spark, "t-extract"), shared_path(spark, "t-stats")
    schema = "ym string, nation string, industry string, age_level string, trans_count double, trans_total double"
    spark.createDataFrame([("202401", None, "a", None, None, None)], schema).write.partitionBy("ym").parquet(path)
    fills, _ = monthly.fill_values_by_month(spark, path, state, schema)
    assert fills == {"trans_count": None, "trans_total": None, "ym": "202401", "nation": None, "industry": "a", "age_level": None}


# -- metadata ----------------------------------------------------------------------

def test_months_come_from_footers(spark, make_fact):
    path = shared_path(spark, "t-fact")
    sinks.append_new_rows(spark, make_fact(ROWS + [("202401", "n", "q", "q", 1, 1)]), path)
    months = tables.stored_months(spark, path)
    plan = months._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [ym]" in plan
    assert {(r["ym"], r["rows"]) for r in months.collect()} == {("202401", 4), ("202402", 3), ("202403", 3)}
    sinks.append_new_rows(spark, make_fact([("202405", "n", "a", "x", 1, 1)]), path)
    assert ("202405", 1) in {(r["ym"], r["rows"]) for r in tables.stored_months(spark, path).collect()}
    # Reading rows is as before: the other source was for that one table.
    assert "FileScan parquet" in sinks.read_fact(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_versions_run_no_job(spark, make_fact):
    path = shared_path(spark, "t-fact")
    sinks.append_new_rows(spark, make_fact(ROWS), path)
    many = shared_path(spark, "t-many")
    spark.range(200).repartition(80).write.parquet(many)
    frames = [spark.read.parquet(path), spark.read.parquet(many)]
    before = jobs(spark)
    seen = data_version(*frames)
    assert data_version(*frames) == seen and path_mark(spark, path) and jobs(spark) == before
    spark.range(201).repartition(80).write.mode("overwrite").parquet(many)
    assert data_version(spark.read.parquet(path), spark.read.parquet(many)) != seen


def test_fact_listing_is_kept_until_a_write(spark, make_fact):
    path = shared_path(spark, "t-fact")
    sinks.append_new_rows(spark, make_fact(ROWS), path)
    spark.conf.set(tables.FACT_PATH_KEY, path)
    spark.conf.set(tables.FACT_SOURCE_KEY, "made-up")
    try:
        assert tables.fact_table(spark, "made-up") is tables.fact_table(spark, "made-up")
        assert tables.fact_months(spark, "made-up").count() == 3
        sinks.append_new_rows(spark, make_fact([("odd", "n", "a", "x", 1, 1)]), path)
        assert tables.fact_table(spark, "made-up").count() == 10
        assert {r["ym"] for r in tables.fact_months(spark, "made-up").collect()} == {"202401", "202402", "202403", "odd"}
    finally:
        spark.conf.unset(tables.FACT_PATH_KEY)
        spark.conf.unset(tables.FACT_SOURCE_KEY)


# -- sink and types ------------------------------------------------------------------

def test_dirty_months_share_a_folder(spark, make_fact):
    path = shared_path(spark, "t-dirty")
    rows = [("202401", "n", "a", "x", 1, 1), ("2024-01", "n", "a", "x", 1, 1), ("", "n", "a", "x", 1, 1), (None, "n", "a", "x", 1, 1), ("未知", "n", "a", "x", 1, 1)]
    assert sinks.append_new_rows(spark, make_fact(rows), path) == 5 and sinks.append_new_rows(spark, make_fact(rows), path) == 0
    assert sorted(f for f in os.listdir(path.removeprefix("file:")) if f.startswith("ym=")) == ["ym=202401", "ym=__HIVE_DEFAULT_PARTITION__"]
    fact = sinks.read_fact(spark, path)
    assert {r["ym"] for r in fact.collect()} == {r[0] for r in rows}
    assert fact.where("ym = '202401'").count() == 1
    assert "PartitionFilters: [isnotnull(ym" in fact.where("ym = '202401'")._jdf.queryExecution().executedPlan().toString()


def test_numbers_beyond_bigint_are_missing(spark):
    raw = spark.createDataFrame([("202401", "n", "a", "x", "1e30", "5"), ("202401", "n", "a", "x", "7", "-9e18"), ("202401", "n", "b", "x", "9", "-1e19")],
                                "`年月` string, `地區` string, `信用卡產業別` string, `年齡層` string, `信用卡交易筆數` string, `信用卡交易金額[新臺幣]` string")
    parsed = {(r["trans_count"], r["trans_total"]) for r in clean.parsed_extract(raw).collect()}
    assert parsed == {(None, 5.0), (7.0, -9e18), (9.0, None)}
    assert clean.clean_extract(raw).count() == 3
    big = spark.createDataFrame([("a", "b", "c", "d", 1e30, 2.5)], "ym string, nation string, industry string, age_level string, trans_count double, trans_total double")
    assert [(r["trans_count"], r["trans_total"]) for r in clean.final_types(big).collect()] == [(None, 2)]


@pytest.mark.parametrize("months, want", [(["202401", None], 2), ([None], 1), (["x"], 0)])
def test_month_condition(spark, months, want):
    df = spark.createDataFrame([("202401",), (None,), ("202402",)], "ym string")
    assert df.where(monthly.in_months(months)).count() == want


def test_status_events_read_the_requests_once(spark):
    """The accepted requests are stored: no delivery derives them from the events again."""
    from spendlens.plans import catalog
    catalog.queries()  # registers in the order the modules need
    from spendlens.plans import catalog_stream
    events = catalog_stream._status_events(spark, "/root/testdata/sf0.001")
    assert "events.parquet" not in " ".join(events.inputFiles()) and "accepted-requests" in " ".join(events.inputFiles())
