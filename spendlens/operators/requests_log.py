"""Analytics over a log of chart requests.

A request row: ``id, chart_type, params struct<x_axis, y_axis, value,
value2>, figure struct<figsize, set_title, set_xlabel, set_ylabel>, filters
struct<start_month, end_month, topn, industry, age_level>, create_by,
create_at`` (``schema.REQUEST_SCHEMA``).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import CHART_TYPES, DIMENSIONS, HEATMAP_VALUE, HEATMAP_VALUE2, METRICS


def canonical_json(r: str = "") -> Column:
    """Canonical JSON text of a request's cache-relevant fields: keys sorted,
    NULL fields left out, compact separators, non-ASCII kept as is.  The
    author and time are not part of it."""
    p = lambda c: F.col(f"{r}{c}")
    doc = F.struct(
        p("filters.age_level").alias("age_level"),
        p("chart_type").alias("chart_type"),
        p("filters.end_month").alias("end_month"),
        p("filters.industry").alias("industry"),
        F.struct(p("figure.figsize").alias("figsize"), p("figure.set_title").alias("set_title"),
                 p("figure.set_xlabel").alias("set_xlabel"),
                 p("figure.set_ylabel").alias("set_ylabel")).alias("params_figure"),
        F.struct(p("params.value").alias("value"), p("params.value2").alias("value2"),
                 p("params.x_axis").alias("x_axis"), p("params.y_axis").alias("y_axis")).alias("params_json"),
        p("filters.start_month").alias("start_month"),
        p("filters.topn").alias("topn"),
    )
    return F.to_json(doc, {"ignoreNullFields": "true"})


def with_fingerprint(requests: DataFrame, data_version: str | None = None,
                     name: str = "cache_key") -> DataFrame:
    """SHA-256 hex of the canonical JSON.  ``data_version`` (optional)
    is mixed in so keys change when the fact table is reloaded."""
    text = canonical_json()
    if data_version is not None:
        text = F.concat(text, F.lit("|" + data_version))
    return requests.withColumn(name, F.sha2(text, 256))


# Rule codes, in the order they are checked.
RULES = (
    "INVALID_CHART_TYPE", "INVALID_X_AXIS", "INVALID_Y_AXIS", "INVALID_VALUE",
    "SAME_AXES", "HEATMAP_MISSING_y_axis", "PIE_NO_NEED_y_axis", "HEATMAP_METRICS",
    "INVALID_TOPN", "FIGSIZE_LENGTH", "FIGSIZE_NOT_POSITIVE", "INVALID_PERIOD",
)


def rule_checks() -> list[tuple[str, Column]]:
    """(code, broken?) for every rule, in checking order."""
    ct, x, y = F.col("chart_type"), F.col("params.x_axis"), F.col("params.y_axis")
    v, v2 = F.col("params.value"), F.col("params.value2")
    fs, topn = F.col("figure.figsize"), F.col("filters.topn")
    dims = [F.lit(d) for d in sorted(DIMENSIONS)]
    mets = [F.lit(m) for m in sorted(METRICS)]
    checks = [
        ~ct.isin(*[F.lit(c) for c in CHART_TYPES]) | ct.isNull(),
        x.isNull() | ~x.isin(*dims),
        y.isNotNull() & ~y.isin(*dims),
        # A chart of sums cannot run without its metric; a heatmap's is checked below.
        (v.isNotNull() & ~v.isin(*mets)) | (v2.isNotNull() & ~v2.isin(*mets))
        | (v.isNull() & ct.isin("bar", "line", "pie")),
        y.isNotNull() & (y == x),
        (ct == "heatmap") & y.isNull(),
        (ct == "pie") & y.isNotNull(),
        (ct == "heatmap") & ((F.coalesce(v, F.lit("")) != HEATMAP_VALUE)
                             | (F.coalesce(v2, F.lit("")) != HEATMAP_VALUE2)),
        topn.isNotNull() & (topn <= 0),
        fs.isNotNull() & (F.size(fs) != 2),
        fs.isNotNull() & (F.size(fs) == 2)
        & (F.coalesce(F.get(fs, 0) <= 0, F.lit(True)) | F.coalesce(F.get(fs, 1) <= 0, F.lit(True))),
        F.col("filters.start_month") > F.col("filters.end_month"),
    ]
    return [(code, F.coalesce(c, F.lit(False))) for code, c in zip(RULES, checks)]


def validate(requests: DataFrame) -> DataFrame:
    """R3 per request: ``accepted`` and the ';'-joined codes of the broken
    rules.  Plain boolean / string expressions (no arrays or lambdas), so a
    filter on ``accepted`` stays inside whole-stage codegen."""
    checks = rule_checks()
    ok = ~reduce(lambda a, b: a | b, [c for _, c in checks])
    codes = F.concat_ws(";", *[F.when(c, F.lit(code)) for code, c in checks])
    return requests.select("*", ok.alias("accepted"), codes.alias("error_codes"))


_ID_SHIFT = 2 ** 63          # ids are shifted to be non-negative
_ID_SPAN = 10 ** 20          # > 2**64, room for any shifted id


def order_key(ts: str = "create_at", id_col: str = "id", ntz: bool = False) -> Column:
    """``(ts, id)`` packed into one ``decimal(38,0)``, ordered like the pair.

    A min over a struct needs a sort-based aggregate; a min over a decimal
    stays a hash aggregate with map-side partial results.  A time without a zone
    (``ntz``) is counted from a fixed time of its own kind: through the session
    time zone two of them could swap around a clock change.
    """
    if ntz:
        since = F.expr(f"CAST(CAST(`{ts}` - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6))")
        micros = (since * F.lit(1_000_000)).cast("decimal(38,0)")
    else:
        micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(38,0)")
    shifted = F.col(id_col).cast("decimal(38,0)") + _dec(_ID_SHIFT)
    return (micros * _dec(_ID_SPAN) + shifted).cast("decimal(38,0)")


def id_of(key: Column) -> Column:
    """The id packed into an ``order_key`` value."""
    return (F.pmod(key, _dec(_ID_SPAN)) - _dec(_ID_SHIFT)).cast("bigint")


def _dec(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def first_requests(requests: DataFrame, key: str = "cache_key") -> DataFrame:
    """Per key: the id of its first request (by time, then id), the number
    of requests and the latest time -- one hash aggregation with map-side
    partial results, so a key holding a third of the log costs no more than
    any other."""
    ntz = isinstance(requests.schema["create_at"].dataType, T.TimestampNTZType)
    g = requests.groupBy(key).agg(F.min(order_key(ntz=ntz)).alias("__first"),
                                  F.count(F.lit(1)).alias("n_requests"),
                                  F.max("create_at").alias("last_at"))
    return g.select(key, id_of(F.col("__first")).alias("first_id"), "n_requests", "last_at")


def mark_hits(requests: DataFrame, key: str = "cache_key", firsts: DataFrame | None = None) -> DataFrame:
    """R2: the first request of a key (by time, then id) is a miss, every
    later one a hit; ``result_id`` is the id of the key's first request.

    The per-key firsts are joined back on the key.  Pass them as a stored table
    (``firsts``): then both sides of the join are plain exchanges and AQE
    splits an oversized key partition of the log, repeating the key's single row
    for each split -- it cannot when the aggregate sits on the join's own
    exchange.  A per-key window would sort a hot key's rows in one task.
    """
    firsts = (first_requests(requests, key) if firsts is None else firsts).select(key, "first_id")
    j = requests.join(firsts, key)
    return j.select(*[F.col(c) for c in requests.columns],
                    (F.col("id") != F.col("first_id")).alias("cache_hit"),
                    F.col("first_id").alias("result_id"))


def result_records(requests: DataFrame, key: str = "cache_key", firsts: DataFrame | None = None,
                   points: DataFrame | None = None) -> DataFrame:
    """One result record per key, taken from its first request, with
    request counts.  The first request's fields are fetched by joining the
    per-key firsts back on the request id.

    ``points`` (``key, points_json``, one row per answered key) decides the
    status: READY with a points document, FAILED without one (the chart has no
    data).  Without ``points`` the records are those of answered keys.
    """
    firsts = first_requests(requests, key) if firsts is None else firsts
    cols = requests.select(F.col("id").alias("first_id"), "chart_type", "params", "figure",
                           "create_by", "create_at")
    j = firsts.join(cols, "first_id")
    status, extra = F.lit("READY"), []
    if points is not None:
        j = j.join(points.select(key, "points_json"), key, "left")
        status = F.when(F.col("points_json").isNotNull(), F.lit("READY")).otherwise(F.lit("FAILED"))
        extra = [F.col("points_json")]
    return j.select(F.col("first_id").alias("result_id"), key, "chart_type",
                    F.col("params").alias("params_json"), F.col("figure").alias("params_figure"),
                    status.alias("status"), "create_by", "create_at",
                    F.col("last_at").alias("update_at"), "n_requests", *extra)


def requests_with_results(marked: DataFrame, results: DataFrame) -> DataFrame:
    """Each logged request with its result record (left join on the
    nullable ``result_id``)."""
    r = results.select("result_id", "status", "n_requests")
    return marked.join(r, "result_id", "left")


def first_match(df: DataFrame, column: str, value, order_by: str = "id") -> DataFrame:
    """First row whose ``column`` equals ``value`` (unknown column is an
    error), by ``order_by``."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}; columns: {df.columns}")
    return df.where(F.col(column) == F.lit(value)).orderBy(order_by).limit(1)


def points_document(points: DataFrame, key_cols: list[str], pos: str = "pos",
                    fields: tuple[str, ...] = ("x", "y", "amount", "share", "growth")) -> DataFrame:
    """One JSON array of points per key, in chart order (NULL fields are
    left out).  Each array holds one chart's points, bounded by its top-N or
    month count."""
    present = [f for f in fields if f in points.columns]
    rec = F.struct(F.col(pos).alias("pos"), *[F.col(f) for f in present])
    g = points.groupBy(*key_cols).agg(F.sort_array(F.collect_list(rec)).alias("pts"))
    doc = F.to_json(F.transform("pts", lambda p: p.dropFields("pos")))
    return g.select(*key_cols, doc.alias("points_json"))
