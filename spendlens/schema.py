"""Schemas, vocabularies and the fixed values the results depend on."""
from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must stay exactly as written for results to match the
# behaviour being reproduced (source headers, labels, units, defaults).
# ---------------------------------------------------------------------------

# Source header -> canonical column name (raw extracts use these headers).
HEADER_MAP = {
    "年月": "ym",
    "地區": "nation",
    "信用卡產業別": "industry",
    "年齡層": "age_level",
    "信用卡交易筆數": "trans_count",
    "信用卡交易金額[新臺幣]": "trans_total",
}

# Canonical fact columns, in order.
FACT_COLUMNS = ["ym", "nation", "industry", "age_level", "trans_count", "trans_total"]
TEXT_COLUMNS = ["ym", "nation", "industry", "age_level"]
METRIC_COLUMNS = ["trans_count", "trans_total"]

# Columns a chart may put on an axis / use as a value.
DIMENSIONS = frozenset({"ym", "industry", "age_level"})
METRICS = frozenset({"trans_count", "trans_total"})

# Display labels per column name.
LABELS = {
    "ym": "年月",
    "industry": "產業別",
    "age_level": "年齡層",
    "trans_count": "交易筆數",
    "trans_total": "交易金額",
}

# What a heatmap's cells are, behind its default title.
HEATMAP_MEASURE = "_平均交易金額"

# Unit divisor and unit text per metric (anything else: divisor 1, no text).
UNITS = {
    "trans_count": (10_000_000, " (單位：千萬筆) "),
    "trans_total": (1_000_000_000, " (單位：十億元)"),
}

# Pie slices under this percentage are folded into the "other" label.
OTHER_LABEL = "其他"
PIE_OTHER_BELOW_PCT = 10
PIE_RELABEL_BELOW = 0.10

# Age band label prefix that sorts first; labels without a number sort last.
AGE_FIRST_PREFIX = "未滿20"
AGE_FIRST_LABEL = "未滿20歲"
AGE_NO_NUMBER_KEY = 999

# Top-N default and bounds.
TOPN_DEFAULT = 20
TOPN_MIN = 1
TOPN_MAX = 200

# Dashboard amounts are sums of trans_total divided by this.
DASHBOARD_UNIT = 1_000_000_000

# Line chart shows at most this many month labels.
MAX_AXIS_LABELS = 12

# Axis headroom factor.
AXIS_HEADROOM = 1.1

# Missing-value tokens of the CSV reader: the pandas defaults plus the extra
# tokens ('', ' ', 'NaN', 'Na') the extract loader adds.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null", " ", "Na",
)

# Request vocabularies.
CHART_TYPES = ("bar", "line", "pie", "heatmap")
RESULT_STATUSES = ("PENDING", "READY", "FAILED")
DEFAULT_FIGSIZE = (10.0, 8.0)

# Heatmap only accepts this metric pair (value / value2).
HEATMAP_VALUE = "trans_total"
HEATMAP_VALUE2 = "trans_count"

# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------

FACT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in TEXT_COLUMNS]
    + [T.StructField(c, T.LongType(), True) for c in METRIC_COLUMNS]
)

# Raw extracts are read with every column as text.
RAW_SCHEMA = T.StructType([T.StructField(h, T.StringType(), True) for h in HEADER_MAP])

PARAMS_SCHEMA = T.StructType([
    T.StructField("x_axis", T.StringType()),
    T.StructField("y_axis", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("value2", T.StringType()),
])

FIGURE_SCHEMA = T.StructType([
    T.StructField("figsize", T.ArrayType(T.DoubleType())),
    T.StructField("set_title", T.StringType()),
    T.StructField("set_xlabel", T.StringType()),
    T.StructField("set_ylabel", T.StringType()),
])

FILTER_SCHEMA = T.StructType([
    T.StructField("start_month", T.StringType()),
    T.StructField("end_month", T.StringType()),
    T.StructField("topn", T.IntegerType()),
    T.StructField("industry", T.StringType()),
    T.StructField("age_level", T.StringType()),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("chart_type", T.StringType()),
    T.StructField("params", PARAMS_SCHEMA),
    T.StructField("figure", FIGURE_SCHEMA),
    T.StructField("filters", FILTER_SCHEMA),
    T.StructField("create_by", T.LongType()),
    T.StructField("create_at", T.TimestampNTZType()),
])
