"""Cleaning chain: the reference's pandas examples plus edge cases."""
import math
import random

import pytest
from pyspark.sql import functions as F

from spendlens.functions.numbers import parse_number
from spendlens.operators import clean as C
from spendlens.operators.quantiles import exact_medians, kth_values


def _col(df, c):
    return [r[c] for r in df.orderBy(F.monotonically_increasing_id()).collect()]


def test_median_fill(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    out = C.impute(df, num_cols=["x"], str_cols=[])
    assert sorted(r.x for r in out.collect()) == [1.0, 2.0, 3.0]


def test_median_even_count_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x double")
    rep = C.ImputeReport()
    C.impute(df, num_cols=["x"], str_cols=[], report=rep)
    assert rep.fill_values["x"] == 3.0
    assert rep.missing_ratio["x"] == pytest.approx(0.2)


def test_mode_fill_and_ties(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "x string")
    out = C.impute(df, num_cols=[], str_cols=["x"])
    assert sorted(r.x for r in out.collect()) == ["a", "b", "b", "b"]
    tie = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    rep = C.ImputeReport()
    C.impute(tie, num_cols=[], str_cols=["x"], report=rep)
    assert rep.fill_values["x"] == "a"  # ties -> smallest


def test_mode_all_missing_left_missing(spark):
    df = spark.createDataFrame([(None,), (None,), (None,)], "x string")
    out = C.impute(df, num_cols=[], str_cols=["x"])
    assert [r.x for r in out.collect()] == [None, None, None]


def test_no_missing_no_fill(spark):
    df = spark.createDataFrame([(1.0,), (5.0,)], "x double")
    rep = C.ImputeReport()
    C.impute(df, num_cols=["x"], str_cols=[], report=rep)
    assert rep.fill_values == {}


def test_dedup_none_and_one_copy(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "x int, y string")
    assert C.drop_exact_duplicates(a).count() == 3
    b = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    assert sorted(tuple(r) for r in C.drop_exact_duplicates(b).collect()) == [(1, "a"), (2, "b")]
    st = C.duplicate_stats(b).first()
    assert (st.rows_before, st.rows_after, st.duplicates) == (3, 2, 1)


@pytest.mark.parametrize("text,strip,space", [
    ("1,234", 1234.0, None), (" 12 ", 12.0, 12.0), ("n/a", None, None), ("", None, None),
    ("nan", None, None), ("inf", None, None), ("1e3", 1000.0, 1000.0), ("-2.5", -2.5, -2.5),
    ("0x10", None, None), ("1d", None, None), (None, None, None), ("\t7　", 7.0, 7.0),
])
def test_parse_number(spark, text, strip, space):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(parse_number("t", "strip").alias("a"), parse_number("t", "space").alias("b")).first()
    assert r.a == strip and r.b == space


def test_final_types_truncate(spark):
    df = spark.createDataFrame([("202401", "n", "i", "a", 2.5, -2.5)],
                               "ym string, nation string, industry string, age_level string, "
                               "trans_count double, trans_total double")
    r = C.final_types(df).first()
    assert (r.trans_count, r.trans_total) == (2, -2)


def test_clean_extract_end_to_end(spark):
    rows = [("202401", "TW", "food", "未滿20歲", "1,000", "5"),
            ("202401", "TW", "food", "未滿20歲", "1,000", "5"),
            ("202402", "TW", None, "20(含)-30歲", "n/a", "7"),
            (None, "TW", "food", "20(含)-30歲", "3000", None)]
    hdr = ["年月", "地區", "信用卡產業別", "年齡層", "信用卡交易筆數", "信用卡交易金額[新臺幣]"]
    df = spark.createDataFrame(rows, hdr)
    out = sorted(tuple(r) for r in C.clean_extract(df).collect())
    # count median of (1000, 1000, 3000) = 1000; total median of (5, 5, 7) = 5;
    # industry mode 'food'; month mode '202401'; the two copies collapse.
    assert out == sorted([
        ("202401", "TW", "food", "未滿20歲", 1000, 5),
        ("202402", "TW", "food", "20(含)-30歲", 1000, 7),
        ("202401", "TW", "food", "20(含)-30歲", 3000, 5),
    ])


def test_missing_columns_error(spark):
    df = spark.createDataFrame([("x",)], "ym string")
    with pytest.raises(ValueError, match="missing columns"):
        C.clean_extract(df)


def _brute_median(xs):
    xs = sorted(x for x in xs if x is not None and not math.isnan(x))
    n = len(xs)
    if n == 0:
        return None
    return xs[n // 2] if n % 2 else (xs[n // 2 - 1] + xs[n // 2]) / 2


@pytest.mark.parametrize("seed", range(4))
def test_exact_median_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = rnd.choice([9, 10, 5000, 20001])
    a = [rnd.lognormvariate(8, 3) for _ in range(n)]            # heavy tail
    b = [float(rnd.randint(0, 3)) for _ in range(n)]            # heavy ties
    c = [rnd.choice([-1e300, 1e300, 0.0, -5.0, None]) for _ in range(n)]
    df = spark.createDataFrame(list(zip(a, b, c)), "a double, b double, c double")
    got = exact_medians(df, ["a", "b", "c"])
    assert got["a"] == _brute_median(a)
    assert got["b"] == _brute_median(b)
    assert got["c"] == _brute_median(c)


@pytest.mark.parametrize("bracket", [[-5.0, -1.0], [0.0, 1e9], [250.0, 750.0], None])
def test_exact_median_from_any_bracket(spark, bracket, monkeypatch):
    from spendlens.operators import quantiles
    monkeypatch.setattr(quantiles, "FINAL_ROWS", 64)
    rnd = random.Random(11)
    xs = [rnd.random() * 1000 for _ in range(2000)] + [None, float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    assert exact_medians(df, ["v"], {"v": bracket}) == {"v": _brute_median(xs)}


def test_fill_values_of_columns_with_and_without_values(spark):
    df = spark.createDataFrame([(1.0, None, "b", None), (4.0, None, "a", None), (None, None, "b", None), (9.0, None, None, None), (2.0, None, "a", None)],
                               "x double, none double, t string, no_text string")
    r = C.fill_values(df, ["x", "none"], ["t", "no_text"]).collect()
    assert [tuple(i) for i in r] == [(3.0, None, "a", None)]


def test_kth_values_small_buckets_force_several_passes(spark):
    rnd = random.Random(7)
    xs = [rnd.random() * 1000 for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = kth_values(df, {"v": [1, 1500, 3000]}, buckets=4, final_rows=16)
    s = sorted(xs)
    assert got["v"] == {1: s[0], 1500: s[1499], 3000: s[2999]}


def test_missing_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    got = {r.column: r.missing_ratio for r in C.missing_profile(df).collect()}
    assert got == {"a": 0.5, "b": 1.0}


def test_a_metric_is_parsed_once(spark):
    """A text is searched once for its bound and its value, not in every branch that names it."""
    from spendlens.operators.clean import parse_metrics
    df = parse_metrics(spark.range(1).selectExpr("cast(id as string) trans_count", "'1e999' trans_total"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp") <= 2 and [tuple(r) for r in df.collect()] == [(0.0, None)]
