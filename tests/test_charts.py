"""Chart, dashboard and derive operators on hand-made fact tables."""
import pytest
from pyspark.sql import functions as F

from spendlens.functions.labels import age_sort_key, slug
from spendlens.operators import aggregates as A
from spendlens.operators import reshape as P
from spendlens.operators import windows as W
from spendlens.operators.filters import (ChartFilter, ChartParamsError, check_columns, clamp_topn,
                                         require_rows)
from spendlens.plans import charts, dashboard

U20 = "未滿20歲"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("pos").collect()]


def test_bar_topn_ties_broken_by_label(make_fact):
    fact = make_fact([("202401", "n", "b", U20, 1, 100), ("202401", "n", "a", U20, 1, 100),
                      ("202401", "n", "c", U20, 1, 50), ("202402", "n", "d", U20, 1, 10)])
    pts = charts.bar_points(fact, "industry", "trans_total", ChartFilter(topn=2), divisor=100)
    assert rows(pts, "x", "y", "share") == [("a", 1.0, 0.5), ("b", 1.0, 0.5)]
    assert pts.where(F.col("growth").isNotNull()).count() == 0


def test_bar_month_axis_all_months_ascending(make_fact):
    fact = make_fact([("202402", "n", "a", U20, 1, 300), ("202401", "n", "a", U20, 1, 100)])
    pts = charts.bar_points(fact, "ym", "trans_total", ChartFilter(topn=1), divisor=100)
    assert rows(pts, "x", "y", "share") == [("202401", 1.0, 0.25), ("202402", 3.0, 0.75)]


def test_rounding_half_even_on_scaled_value(make_fact):
    fact = make_fact([("202401", "n", "a", U20, 1, 125), ("202401", "n", "b", U20, 1, 135)])
    pts = charts.bar_points(fact, "industry", "trans_total", divisor=100)
    assert dict(rows(pts, "x", "y")) == {"a": 1.25, "b": 1.35}
    pts = charts.bar_points(fact, "industry", "trans_total", divisor=1000)
    assert dict(rows(pts, "x", "y")) == {"a": 0.12, "b": 0.14}


def test_line_limit_keeps_first_labels(make_fact):
    fact = make_fact([("202401", "n", x, U20, 1, v) for x, v in [("c", 900), ("a", 1), ("b", 2)]])
    pts = charts.line_points(fact, "industry", "trans_total", ChartFilter(topn=2), divisor=1)
    assert [r[0] for r in rows(pts, "x")] == ["a", "b"]


def test_filters_and_empty_result(make_fact):
    fact = make_fact([("202401", "n", "a", U20, 1, 10), ("202403", "n", "a", "x", 1, 20)])
    f = ChartFilter(start_month="202402", end_month="202412", age_level="x")
    pts = charts.bar_points(fact, "industry", "trans_total", f, divisor=1)
    assert rows(pts, "x", "y") == [("a", 20.0)]
    empty = charts.bar_points(fact, "industry", "trans_total", ChartFilter(industry="zzz"))
    with pytest.raises(ChartParamsError):
        require_rows(empty)


def test_pie_other_bucket_edge(make_fact):
    # shares 85 %, 9.5 % -> 10 (kept: not under 10), 5.5 % -> 6 (other)
    fact = make_fact([("202401", "n", "a", U20, 1, 850), ("202401", "n", "b", U20, 1, 95),
                      ("202401", "n", "c", U20, 1, 55)])
    pts = charts.pie_points(fact, "industry", "trans_total")
    assert rows(pts, "x", "amount") == [("a", 85.0), ("b", 10.0), ("其他", 6.0)]


def test_pie_zero_total_gives_null_share(make_fact):
    fact = make_fact([("202401", "n", "a", U20, 1, 0)])
    pts = charts.pie_points(fact, "industry", "trans_total")
    assert rows(pts, "x", "amount") == [("其他", None)]


def test_heatmap_zero_divisor_and_rules(make_fact):
    fact = make_fact([("202401", "n", "a", U20, 0, 10), ("202401", "n", "a", "20(含)-30歲", 2, 10)])
    pts = charts.heatmap_points(fact, "industry", "age_level")
    got = {(r.x, r.y): r.amount for r in pts.collect()}
    assert got == {("a", U20): None, ("a", "20(含)-30歲"): 5.0}
    with pytest.raises(ChartParamsError):
        A.heatmap_cells(fact, "industry", "age_level", value="trans_count", value2="trans_total")
    with pytest.raises(ChartParamsError):
        A.heatmap_cells(fact, "industry", "industry")
    with pytest.raises(ChartParamsError):
        A.heatmap_cells(fact, "industry", None)


def test_column_allow_list_reports_all_errors():
    with pytest.raises(ValueError) as e:
        check_columns("nation", value="ym")
    assert "x_axis" in str(e.value) and "value" in str(e.value)
    check_columns("industry", "age_level", "trans_total", "trans_count")


def test_clamp_topn():
    assert [clamp_topn(None), clamp_topn(0), clamp_topn(5), clamp_topn(999)] == [20, 1, 5, 200]


def test_age_sort_key_and_order(spark):
    labels = ["40(含)歲以上", "未滿20歲", "20(含)-30歲", "unknown", " 未滿20歲 "]
    df = spark.createDataFrame([(x,) for x in labels], "age_level string")
    got = {r.age_level: r.k for r in df.select("age_level", age_sort_key("age_level").alias("k")).collect()}
    assert got == {"40(含)歲以上": 40, "未滿20歲": 0, "20(含)-30歲": 20, "unknown": 999, " 未滿20歲 ": 0}
    assert [r.age_level for r in P.sort_by_age(df).collect()][:2] == [" 未滿20歲 ", "未滿20歲"]


def test_growth_pads_and_zero(spark):
    df = spark.createDataFrame([("a", "202401", 10.0), ("a", "202402", None), ("a", "202403", 15.0),
                                ("b", "202401", 0.0), ("b", "202402", 5.0)], "x string, ym string, y double")
    got = {(r.x, r.ym): r.growth for r in W.with_growth(df, "x", "ym").collect()}
    assert got[("a", "202401")] is None
    assert got[("a", "202402")] == 0.0           # carried forward
    assert got[("a", "202403")] == pytest.approx(0.5)
    assert got[("b", "202402")] is None          # growth from zero


def test_label_step(spark):
    df = spark.createDataFrame([(f"2024{m:02d}",) for m in range(1, 13)] + [("202501",)], "x string")
    got = [r.show_label for r in W.with_label_step(df, "x").orderBy("x").collect()]
    assert got == [True, False] * 6 + [True]


def test_dashboard_default_period_and_scoping(make_fact):
    fact = make_fact([("202311", "n", "a", U20, 1, 1000), ("202401", "n", "a", U20, 1, 2000),
                      ("202402", "n", "b", U20, 1, 3000), ("202402", "n", "a", "x", 1, 4000)])
    ov = dashboard.overview(fact, unit=1000)
    assert [(r.ym, r.amount) for r in ov.trend.collect()] == [("202401", 2.0), ("202402", 7.0)]
    assert [(r.industry, r.amount) for r in ov.rank.collect()] == [("a", 6.0), ("b", 3.0)]
    ov2 = dashboard.overview(fact, start_month="202311", industry="a", age_level=U20, unit=1000)
    assert [(r.ym, r.amount) for r in ov2.trend.collect()] == [("202311", 1.0), ("202401", 2.0)]
    assert {r.industry for r in ov2.rank.collect()} == {"a", "b"}   # industry filter: trend only
    drill = dashboard.month_drilldown(fact, unit=1000)
    assert [(r.ym, r.industry, r.rank) for r in drill.collect()] == [("202402", "a", 1), ("202402", "b", 2)]
    with pytest.raises(ChartParamsError):
        dashboard.overview(fact, start_month="202405", end_month="202401")


def test_overview_grouping_sets_equal_separate_panels(make_fact):
    fact = make_fact([("202401", "n", "a", U20, 1, 1000), ("202401", "n", "b", U20, 1, 2000),
                      ("202402", "n", "b", U20, 1, 3000)])
    one = dashboard.overview_one_pass(fact, start_month="202401", unit=1000)
    ov = dashboard.overview(fact, start_month="202401", unit=1000)
    got = {(r.panel, r.ym, r.industry): r.amount for r in one.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "trend"} == {r.ym: r.amount for r in ov.trend.collect()}
    assert {k[2]: v for k, v in got.items() if k[0] == "rank"} == {r.industry: r.amount for r in ov.rank.collect()}


def test_pivot_and_coords(make_fact):
    fact = make_fact([("202401", "n", "b", "20(含)-30歲", 2, 10), ("202401", "n", "a", U20, 1, 3),
                      ("202401", "n", "b", U20, 1, 4)])
    cells = charts.heatmap_points(fact, "industry", "age_level")
    m = {r.y: (r.a, r.b) for r in P.pivot_matrix(cells).collect()}
    assert m == {U20: (3.0, 4.0), "20(含)-30歲": (None, 5.0)}
    co = {(r.x, r.y): (r.x_idx, r.y_idx, r.value) for r in P.heatmap_coords(cells, "industry", "age_level").collect()}
    # chart order is (y, x): ('b', 20-30) comes first, so 'b' gets x index 0;
    # the age axis is indexed in age order.
    assert co[("a", U20)] == (1, 0, 3) and co[("b", "20(含)-30歲")] == (0, 1, 5)


def test_slug(spark):
    df = spark.createDataFrame([("199501-200111  產業別 x 交易金額 (單位：十億元)",)], "s string")
    assert df.select(slug("s")).first()[0] == "199501-200111--產業別-x-交易金額--單位-十億元-"


def test_collation_option(make_fact):
    from spendlens.operators.filters import apply_filters
    fact = make_fact([("202401", "n", "Café", U20, 1, 10), ("202401", "n", "bar", U20, 1, 20)])
    assert apply_filters(fact, ChartFilter(industry="cafe")).count() == 0
    assert apply_filters(fact, ChartFilter(industry="cafe", collation="UNICODE_CI_AI")).count() == 1


def test_dashboard_amount_rounds_exact_decimal_ties(make_fact):
    # 812950 / 1e6 = 0.81295 exactly; as a double it is 0.8129499..., which a
    # binary rounding would take down.  Decimal semantics round it up.
    fact = make_fact([("202401", "n", "a", U20, 1, 812950), ("202401", "n", "b", U20, 1, -812950 - 100)])
    got = {r.industry: r.amount for r in dashboard.overview(fact, "202401", "202401", unit=1e6).rank.collect()}
    assert got == {"a": 0.813, "b": -0.8131}
