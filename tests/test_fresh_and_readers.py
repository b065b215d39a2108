"""Tables follow their sources; readers match columns by name; keys without sentinels."""
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spendlens.config import data_version, session_table, shared_path
from spendlens.operators import requests_log as R
from spendlens.operators.quantiles import exact_medians
from spendlens.plans.serving import serve_sum_charts
from spendlens.schema import FACT_COLUMNS, REQUEST_SCHEMA
from spendlens.sources import tables
from spendlens.sources.extracts import detect_json_layouts, read_csv_extract, read_json_extract
from spendlens.sources.sinks import append_new_rows, read_fact


def put(folder, **files):
    for name, text in files.items():
        with open(os.path.join(folder, name.replace("__", ".")), "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def test_fact_sees_appended_rows(spark, make_fact):
    path = shared_path(spark, "fresh-fact")
    first = [("202401", "n", "a", "x", 1, 10)]
    append_new_rows(spark, make_fact(first), path)
    spark.conf.set(tables.FACT_PATH_KEY, path)
    spark.conf.set(tables.FACT_SOURCE_KEY, "made-up")
    try:
        before = tables.fact_version(spark, "made-up")
        assert tables.fact_table(spark, "made-up").count() == 1
        assert append_new_rows(spark, make_fact(first + [("202402", "n", "a", "x", 2, 20), ("junk", "n", "b", "x", 1, 1), (None, "n", "b", "x", 1, 1)]), path) == 3
        assert tables.fact_table(spark, "made-up").count() == 4 and tables.fact_version(spark, "made-up") != before
        assert append_new_rows(spark, make_fact(first + [("junk", "n", "b", "x", 1, 1), (None, "n", "b", "x", 1, 1)]), path) == 0
        assert read_fact(spark, path).select(FACT_COLUMNS).count() == 4
    finally:
        spark.conf.unset(tables.FACT_PATH_KEY)
        spark.conf.unset(tables.FACT_SOURCE_KEY)


def test_session_table_is_rebuilt_for_new_data(spark):
    path = shared_path(spark, "versioned")
    build = lambda: session_table(spark, "versioned", data_version(spark.read.parquet(path)),
                                  lambda: spark.read.parquet(path).select((F.col("id") * 2).alias("d")))
    spark.range(5).write.parquet(path)
    assert build().count() == 5 and build().count() == 5
    spark.range(9).write.mode("overwrite").parquet(path)
    assert build().count() == 9


def test_csv_columns_by_name_and_quotes(spark, tmpdir_fresh):
    put(tmpdir_fresh, a__csv='﻿x,y,z\n1,"say ""hi"", you",3\n4,5\n', b__csv="z,x,y\r\n30,10,n/a\r\n", c__csv='x,y,z\n7,"8,000",9\n')
    rows = {(r.x, r.y, r.z) for r in read_csv_extract(spark, tmpdir_fresh).collect()}
    assert rows == {("1", 'say "hi", you', "3"), ("4", "5", None), ("10", None, "30"), ("7", "8,000", "9")}


def test_csv_with_too_many_fields_fails(spark, tmpdir_fresh):
    put(tmpdir_fresh, a__csv="x,y\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv_extract(spark, tmpdir_fresh).select("y", "x").collect()


def test_csv_files_that_begin_with_blank_lines(spark, tmpdir_fresh):
    put(tmpdir_fresh, a__csv="x,y\n1,2\n", b__csv="\ny,x\n4,3\n", c__csv=" \r\n\r\n\nx,y\n5,6\n", d__csv="\n\n", e__csv="", f__csv="\ufeff\nx,y\n7,8\n")
    got = sorted((r.x, r.y) for r in read_csv_extract(spark, tmpdir_fresh).select("x", "y").collect())
    assert got == [("1", "2"), ("3", "4"), ("5", "6"), ("7", "8")]
    # A line of tabs is a header for Spark; the rows below it fail the read instead of going missing.
    put(tmpdir_fresh, g__csv="\t\nx,y\n9,10\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv_extract(spark, tmpdir_fresh).collect()


def test_json_layout_of_every_file(spark, tmpdir_fresh):
    rec = lambda k: {"a": str(k), "b": "v"}
    put(tmpdir_fresh, w1__json=json.dumps({"meta": "m", "records": [rec(1), rec(2)]}), w2__json=json.dumps({"meta": "m", "records": [rec(3)]}, indent=1),
        k1__json=json.dumps({"p": rec(4), "q": rec(5)}), arr__json="\n" + json.dumps([rec(6)], indent=2), one__json=json.dumps(rec(7)),
        lines__json="\n".join(json.dumps(rec(k)) for k in (8, 9)))
    kinds = {k: sorted(os.path.basename(f) for f in v) for k, v in detect_json_layouts(spark, tmpdir_fresh).items()}
    assert kinds == {"wrapped": ["w1.json", "w2.json"], "keyed": ["k1.json"], "array": ["arr.json"], "record": ["one.json"], "lines": ["lines.json"]}
    assert sorted(r.a for r in read_json_extract(spark, tmpdir_fresh).collect()) == [str(k) for k in range(1, 10)]


def request(i, at=None, value="trans_total", industry=None, chart="bar", x="industry"):
    return (i, chart, (x, None, value, None), ([10.0, 8.0], None, None, None), (None, None, None, industry, None), 1, at or datetime(2024, 1, 1, 0, 0, i))


def test_star_is_an_ordinary_value(spark, make_fact):
    fact = make_fact([("202401", "n", "*", "a", 1, 5 * 10 ** 9), ("202401", "n", "b", "a", 1, 10 ** 9)])
    log = R.with_fingerprint(spark.createDataFrame([request(1), request(2, industry="*")], REQUEST_SCHEMA))
    keys = {r.cache_key: r.id for r in log.collect()}
    got = {}
    for r in serve_sum_charts(fact, log).collect():
        got.setdefault(keys[r.cache_key], {})[r.x] = r.raw_amount
    assert got == {1: {"*": 5 * 10 ** 9, "b": 10 ** 9}, 2: {"*": 5 * 10 ** 9}}


def test_missing_value_is_rejected(spark):
    log = spark.createDataFrame([request(1, value=None), request(2)], REQUEST_SCHEMA)
    assert {r.id: (r.accepted, r.error_codes) for r in R.validate(log).collect()} == {1: (False, "INVALID_VALUE"), 2: (True, "")}


def test_first_request_across_a_clock_change(spark):
    rows = [(1, "2024-03-10 03:00:00"), (2, "2024-03-10 02:30:00")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    for z in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", z)
        try:
            df = spark.createDataFrame(rows, "id long, t string").select("id", F.lit("k").alias("cache_key"), F.to_timestamp_ntz("t").alias("create_at"))
            assert R.first_requests(df).first().first_id == 2
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)


def test_status_follows_points(spark):
    log = R.with_fingerprint(spark.createDataFrame([request(1), request(2, industry="none")], REQUEST_SCHEMA))
    points = log.where("id = 1").select("cache_key", F.lit("[]").alias("points_json"))
    assert {r.result_id: r.status for r in R.result_records(log, points=points).collect()} == {1: "READY", 2: "FAILED"}


def test_hot_key_of_a_stored_first_table_is_split(spark):
    n = 60_000
    log = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("cache_key"),
                                F.lit("x" * 50).alias("pad"), F.timestamp_seconds("id").alias("create_at"))
    a, b = shared_path(spark, "hot-log"), shared_path(spark, "hot-firsts")
    log.repartition(8).write.parquet(a)
    log = spark.read.parquet(a)
    R.first_requests(log).write.parquet(b)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        marked = R.mark_hits(log, firsts=spark.read.parquet(b))
        assert marked.where("cache_hit").count() == n // 2 - 1
        marked.write.format("noop").mode("overwrite").save()
        marked.collect()
        assert "skew=true" in marked._jdf.queryExecution().executedPlan().toString().lower().replace("isskewjoin", "skew")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_median_of_huge_and_close_values(spark):
    rows = [(-1.7e308,), (1.7e308,), (1.0,), (1.0000000000000002,), (1.0,)]
    df = spark.createDataFrame(rows * 2000, "v double")
    assert exact_medians(df, ["v"])["v"] == 1.0
