"""Batch serving equals the single-chart operators, request by request."""
from datetime import datetime

from pyspark.sql import functions as F

from spendlens.operators import requests_log as R
from spendlens.operators.filters import ChartFilter
from spendlens.plans import charts
from spendlens.plans.serving import serve_sum_charts
from spendlens.schema import REQUEST_SCHEMA

U20, A2 = "未滿20歲", "20(含)-30歲"


def test_serving_matches_single_charts(spark, make_fact):
    fact = make_fact([
        (f"2024{m:02d}", "n", ind, age, m * k, 1000 * m * k + (7 if ind == "b" else 0))
        for m in range(1, 7) for k, (ind, age) in enumerate(
            [("a", U20), ("b", U20), ("b", A2), ("c", A2), ("a", A2)], start=1)])
    specs = [
        ("bar", "industry", "trans_total", None, None, None, None, None),
        ("bar", "industry", "trans_count", "202402", "202405", None, A2, 2),
        ("bar", "ym", "trans_total", "202403", None, "b", None, 1),
        ("bar", "age_level", "trans_count", None, "202404", "a", None, None),
        ("line", "industry", "trans_total", None, None, None, U20, 2),
        ("line", "ym", "trans_count", None, None, "c", A2, None),
        ("line", "age_level", "trans_total", "202406", "202406", None, None, 1),
        ("bar", "industry", "trans_total", "209901", None, None, None, None),   # no data
    ]
    rows = [(i, ct, (x, None, v, None), ([10.0, 8.0], None, None, None), (s, e, n, ind, age), 1,
             datetime(2024, 1, 1, 0, 0, i))
            for i, (ct, x, v, s, e, ind, age, n) in enumerate(specs)]
    log = R.with_fingerprint(spark.createDataFrame(rows, REQUEST_SCHEMA))
    keys = {r.id: r.cache_key for r in log.select("id", "cache_key").collect()}
    served = serve_sum_charts(fact, log)
    got = {}
    for r in served.collect():
        got.setdefault(r.cache_key, []).append((r.pos, r.x, r.y, r.share))
    for i, (ct, x, v, s, e, ind, age, n) in enumerate(specs):
        f = ChartFilter(start_month=s, end_month=e, industry=ind, age_level=age, topn=n)
        op = charts.bar_points if ct == "bar" else charts.line_points
        want = sorted((p.pos, p.x, p.y, p.share) for p in op(fact, x, v, f).collect())
        assert sorted(got.get(keys[i], [])) == want, (i, ct, x)


def _fact_rows():
    return [(f"2024{m:02d}", "n", ind, age, m * k, 1000 * m * k + (7 if ind == "b" else 0))
            for m in range(1, 7) for k, (ind, age) in enumerate(
                [("a", U20), ("b", U20), ("b", A2), ("c", A2), ("a", A2)], start=1)]


def _log(spark, specs):
    rows = [(i, ct, (x, y, v, v2), ([10.0, 8.0], None, None, None), (s, e, n, ind, age), 1,
             datetime(2024, 1, 1, 0, 0, i))
            for i, (ct, x, y, v, v2, s, e, ind, age, n) in enumerate(specs)]
    log = R.with_fingerprint(spark.createDataFrame(rows, REQUEST_SCHEMA))
    return log, {r.id: r.cache_key for r in log.select("id", "cache_key").collect()}


def test_pie_and_heatmap_serving_match_single_charts(spark, make_fact):
    from spendlens.plans.serving import serve_heatmap_charts, serve_pie_charts
    fact = make_fact(_fact_rows())
    pies = [("pie", "industry", None, "trans_total", None, None, None, None, None, None),
            ("pie", "ym", None, "trans_count", None, "202402", "202405", None, A2, None),
            ("pie", "age_level", None, "trans_total", None, None, None, "b", None, 1)]
    heats = [("heatmap", "industry", "age_level", "trans_total", "trans_count", None, None, None, None, None),
             ("heatmap", "ym", "industry", "trans_total", "trans_count", "202403", None, None, U20, None)]
    log, keys = _log(spark, pies + heats)
    got_p, got_h = {}, {}
    for r in serve_pie_charts(fact, log).collect():
        got_p.setdefault(r.cache_key, []).append((r.pos, r.x, r.amount))
    for r in serve_heatmap_charts(fact, log).collect():
        got_h.setdefault(r.cache_key, []).append((r.pos, r.x, r.y, r.amount))
    for i, (ct, x, y, v, v2, s, e, ind, age, n) in enumerate(pies + heats):
        f = ChartFilter(start_month=s, end_month=e, industry=ind, age_level=age, topn=n)
        if ct == "pie":
            want = sorted((p.pos, p.x, p.amount) for p in charts.pie_points(fact, x, v, f).collect())
            assert sorted(got_p[keys[i]]) == want, i
        else:
            want = sorted((p.pos, p.x, p.y, p.amount) for p in charts.heatmap_points(fact, x, y, f).collect())
            assert sorted(got_h[keys[i]]) == want, i
