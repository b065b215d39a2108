"""Request-log operators, including the rule cases of the original tests."""
import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spendlens.operators import requests_log as R
from spendlens.schema import REQUEST_SCHEMA


def req(i, chart="bar", x="industry", y=None, value="trans_total", value2=None, figsize=(10.0, 8.0),
        title=None, start=None, end=None, topn=None, industry=None, age=None, by=1, at=None):
    return (i, chart, (x, y, value, value2), (list(figsize) if figsize is not None else None, title, None, None),
            (start, end, topn, industry, age), by, at or datetime(2024, 1, 1, 0, 0, i % 60))


@pytest.fixture
def log(spark):
    def make(rows):
        return spark.createDataFrame(rows, REQUEST_SCHEMA)
    return make


def codes(df):
    return {r.id: r.error_codes for r in R.validate(df).collect()}


def test_rule_cases(log):
    df = log([
        req(1, x="industry", y="industry"),                 # x = y: rejected
        req(2, chart="bar"),                                # y absent, bar: accepted
        req(3, chart="heatmap", value2="trans_count"),      # heatmap without y: rejected
        req(4, chart="heatmap", y="age_level", value2="trans_count"),  # accepted
        req(5, topn=-1), req(6, topn=0), req(7, topn=5),    # topn must be positive
        req(8, figsize=(9.0, 7.0, 8.0)), req(9, figsize=(0.0, 8.0)),   # figsize rules
        req(10, chart="pie", y="ym"),                       # pie takes no y
        req(11, chart="scatter"),                           # unknown chart type
        req(12, chart="heatmap", y="ym", value="trans_count", value2="trans_count"),
    ])
    c = codes(df)
    assert c[1] == "SAME_AXES"
    assert c[2] == "" and c[4] == "" and c[7] == ""
    assert c[3] == "HEATMAP_MISSING_y_axis"
    assert c[5] == c[6] == "INVALID_TOPN"
    assert c[8] == "FIGSIZE_LENGTH" and c[9] == "FIGSIZE_NOT_POSITIVE"
    assert c[10] == "PIE_NO_NEED_y_axis"
    assert c[11] == "INVALID_CHART_TYPE"
    assert c[12] == "HEATMAP_METRICS"


def _python_key(r):
    """Canonical JSON built in plain Python (sorted keys, no NULLs, compact)."""
    def strip(d):
        return {k: (strip(v) if isinstance(v, dict) else v) for k, v in d.items() if v is not None}
    packed = strip({
        "chart_type": r[1],
        "params_json": dict(zip(["x_axis", "y_axis", "value", "value2"], r[2])),
        "params_figure": dict(zip(["figsize", "set_title", "set_xlabel", "set_ylabel"], r[3])),
        "start_month": r[4][0], "end_month": r[4][1], "topn": r[4][2],
        "industry": r[4][3], "age_level": r[4][4],
    })
    s = json.dumps(packed, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def test_fingerprint_matches_python_canonical_json(log):
    rows = [req(1), req(2, title="圖 表", start="202401", topn=7, industry="食品", age="未滿20歲"),
            req(3, chart="heatmap", y="age_level", value2="trans_count", figsize=(12.0, 0.5), end="202412"),
            req(4, by=99)]
    got = {r.id: r.cache_key for r in R.with_fingerprint(log(rows)).collect()}
    for r in rows:
        assert got[r[0]] == _python_key(r)
    assert got[1] == got[4]  # the author is not part of the key


def test_hits_with_hot_key(log):
    rows = [req(i, at=datetime(2024, 1, 1, 0, 0, 59 - i)) for i in range(1, 31)]  # one hot key
    rows += [req(100 + i, industry=f"i{i}") for i in range(5)]                    # five cold keys
    m = R.mark_hits(R.with_fingerprint(log(rows)))
    got = {r.id: (r.cache_hit, r.result_id) for r in m.collect()}
    assert got[30] == (False, 30)          # earliest request of the hot key
    assert all(got[i] == (True, 30) for i in range(1, 30))
    assert all(got[100 + i] == (False, 100 + i) for i in range(5))
    res = R.result_records(R.with_fingerprint(log(rows)))
    n = {r.result_id: r.n_requests for r in res.collect()}
    assert n[30] == 30 and sum(n.values()) == 35


def test_first_match_and_unknown_column(log):
    df = log([req(3, chart="pie"), req(1, chart="pie"), req(2)])
    assert R.first_match(df, "chart_type", "pie").first().id == 1
    with pytest.raises(ValueError):
        R.first_match(df, "nope", 1)


def test_points_document(spark):
    pts = spark.createDataFrame([("k", 2, "b", 1.5, None), ("k", 1, "a", 2.0, 0.5)],
                                "key string, pos long, x string, y double, share double")
    doc = R.points_document(pts, ["key"]).first().points_json
    assert json.loads(doc) == [{"x": "a", "y": 2.0, "share": 0.5}, {"x": "b", "y": 1.5}]
