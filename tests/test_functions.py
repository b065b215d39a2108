"""Column helpers: labels, units, months."""
from spendlens.functions.labels import label_for, period_label
from spendlens.functions.months import add_months_ym, is_valid_ym, ym_to_date, year_start_ym
from spendlens.operators.reshape import unit_text
from pyspark.sql import functions as F


def test_label_for_and_units(spark):
    df = spark.createDataFrame([("ym",), ("trans_total",), ("nation",)], "c string")
    assert [r[0] for r in df.select(label_for("c")).collect()] == ["年月", "交易金額", "nation"]
    assert unit_text("trans_total") == " (單位：十億元)" and unit_text("ym") == ""


def test_months(spark):
    df = spark.createDataFrame([("202401",), ("202412",), ("202513",)], "ym string")
    got = df.select(add_months_ym("ym", -1).alias("p"), add_months_ym("ym", 1).alias("n"),
                    year_start_ym("ym").alias("y"), ym_to_date("ym").alias("d")).collect()
    assert [(r.p, r.n, r.y) for r in got[:2]] == [("202312", "202402", "202401"), ("202411", "202501", "202401")]
    assert got[2].d is None
    assert is_valid_ym("202401") and not is_valid_ym("202413") and not is_valid_ym("2024-01")


def test_period_label(spark):
    df = spark.createDataFrame([(None, "202403", "202001", "202412")], "s string, e string, lo string, hi string")
    r = df.select(period_label(F.col("s"), F.col("e"), F.col("lo"), F.col("hi"))).first()[0]
    assert r == "202001-202403"


def test_titles_and_file_names(spark):
    from spendlens.functions import labels as L
    rows = [("bar", "ym", None, "trans_total", ""), ("line", "nation", None, "trans_count", "圖 1"),
            ("pie", "ym", None, "trans_total", None), ("heatmap", "ym", "industry", "trans_total", None)]
    df = spark.createDataFrame(rows, "kind string, x string, y string, value string, given string")
    title = L.chart_title(F.col("kind"), F.col("x"), F.col("y"), F.col("value"), F.col("given"))
    got = {r["kind"]: r for r in df.select(
        "kind", title.alias("title"), L.titled_period(F.col("kind"), F.lit("199801-199812"), title).alias("shown"),
        L.file_base(F.col("kind"), F.lit("199801-199812"), title).alias("file"),
        L.file_base(F.col("kind"), F.lit(""), F.lit("")).alias("none")).collect()}
    assert got["bar"]["shown"] == "199801-199812  年月 x 交易金額  (單位：十億元)"
    assert got["line"]["title"] == "圖 1  (單位：千萬筆) "
    assert got["pie"]["shown"] == "199801-199812ym x trans_total"
    assert got["heatmap"]["shown"] == "199801-199812  年月 x 產業別_平均交易金額"
    assert got["heatmap"]["file"] == "199801-199812_--年月-x-產業別_平均交易金額"
    assert {r["none"] for r in got.values()} == {"chart"}
