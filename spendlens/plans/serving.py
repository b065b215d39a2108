"""Answer every logged chart request (bar, line, pie, heatmap) in one
distributed job per chart family.

The original service computes a chart per HTTP request.  Over a request log
the same points come from one plan:

1. The fact is aggregated to ``(ym, industry, age_level)`` cells and rolled
   up to the four grains a request can need -- month alone, month+industry,
   month+age, month+industry+age -- with grouping sets.  This table is
   bounded by months x industries x age bands, not by the data volume.
2. Each rolled-up row is listed under its own dimension values and once as
   "any value" (a flag beside the key, so no data value can be mistaken for
   it).  A request finds its rows by a NULL-safe equi-join on the grain and, per
   dimension, the flag and the key: a filtered dimension matches its value, an
   axis dimension without a filter and an unused one match "any".  The month
   range is the only non-equi condition, checked on the joined rows.  No
   nested-loop join, no pair enumeration beyond what the chart needs.
3. The lookup table is broadcast only after its row count is checked against
   the bound; otherwise the join shuffles on the equi keys (few distinct
   keys, so AQE's skew join splits the request side of a hot key).
4. Sums per (request, x) are partial-aggregated right after the join; the
   per-request ordering, top-N, unit scaling and share use windows
   partitioned by request, each holding at most max(months, 200) rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import round_half_even
from ..schema import (OTHER_LABEL, PIE_OTHER_BELOW_PCT, PIE_RELABEL_BELOW, TOPN_DEFAULT, TOPN_MAX,
                      TOPN_MIN, UNITS)
from ..sources.tables import broadcast_if_small


def rollup_lookup(fact: DataFrame) -> DataFrame:
    """Month-grain sums at the four request grains, keyed for the equi-join."""
    cells = fact.groupBy("ym", "industry", "age_level").agg(
        F.sum("trans_count").alias("c"), F.sum("trans_total").alias("t"))
    sets = cells.groupingSets(
        [["ym"], ["ym", "industry"], ["ym", "age_level"], ["ym", "industry", "age_level"]],
        "ym", "industry", "age_level").agg(
        F.sum("c").alias("c"), F.sum("t").alias("t"), F.grouping_id().alias("grain"))

    def keys(col: str, bit: int):
        rolled = (F.col("grain").bitwiseAND(F.lit(bit))) != 0
        every = F.struct(F.lit(True).alias("any"), F.lit(None).cast("string").alias("value"))
        own = F.struct(F.lit(False).alias("any"), F.col(col).alias("value"))
        return F.when(rolled, F.array(every)).otherwise(F.array(own, every))

    return (sets.select("*", F.explode(keys("industry", 2)).alias("ind"))
                .select("*", F.explode(keys("age_level", 1)).alias("age"))
                .select("ym", "industry", "age_level", "c", "t", "grain", F.col("ind.any").alias("ind_any"), F.col("ind.value").alias("ind_key"),
                        F.col("age.any").alias("age_any"), F.col("age.value").alias("age_key")))


def _request_keys(requests: DataFrame) -> DataFrame:
    """Flat request fields plus the lookup keys: the grain (which dimensions
    besides the month the request needs: its axes and its filters) and the
    industry / age key (the filter value, else the wildcard)."""
    x, y = F.col("params.x_axis"), F.col("params.y_axis")
    ind_f, age_f = F.col("filters.industry"), F.col("filters.age_level")
    need_ind = (x == "industry") | (F.coalesce(y, F.lit("")) == "industry") | ind_f.isNotNull()
    need_age = (x == "age_level") | (F.coalesce(y, F.lit("")) == "age_level") | age_f.isNotNull()
    grain = F.when(need_ind, 0).otherwise(2) + F.when(need_age, 0).otherwise(1)
    return requests.select(
        "cache_key", "chart_type", x.alias("x_axis"), y.alias("y_axis"), F.col("params.value").alias("value"),
        F.col("filters.start_month").alias("start_month"), F.col("filters.end_month").alias("end_month"),
        F.col("filters.topn").alias("topn"),
        grain.alias("r_grain"),
        ind_f.alias("r_ind"), age_f.alias("r_age"))


def stored_lookup(spark, fact: DataFrame, source: str) -> DataFrame:
    """The rolled-up lookup written once per session and state of the fact's
    files (shared by every chart family); its row count then comes from
    parquet footers."""
    from ..config import session_table
    from ..sources.tables import fact_version
    return session_table(spark, "serving_lookup", f"{source}@{fact_version(spark, source)}", lambda: rollup_lookup(fact))


def maintained_lookup(spark, fact_path: str, state_path: str) -> tuple[DataFrame, list[str | None]]:
    """The lookup of a stored, growing fact, and the months derived anew for it.

    Every grain of the lookup has the month, so its rows are derived month by
    month: after an append only the months that it touched are read."""
    from ..operators.monthly import refresh_by_month
    return refresh_by_month(spark, fact_path, state_path, rollup_lookup)


def _matched(fact: DataFrame, requests: DataFrame, chart_types: tuple[str, ...],
             lookup: DataFrame | None = None) -> DataFrame:
    """Each distinct request joined to the lookup rows it aggregates."""
    # One row per key: every field is a function of the key, so a distinct
    # over flat columns (a hash aggregate) is enough.
    reqs = _request_keys(requests.where(F.col("chart_type").isin(*chart_types))).distinct()
    lookup = rollup_lookup(fact) if lookup is None else lookup
    lookup = broadcast_if_small(lookup, lookup.count())
    cond = ((reqs.r_grain == lookup.grain)
            & (reqs.r_ind.isNull() == lookup.ind_any) & reqs.r_ind.eqNullSafe(lookup.ind_key)
            & (reqs.r_age.isNull() == lookup.age_any) & reqs.r_age.eqNullSafe(lookup.age_key)
            & (reqs.start_month.isNull() | (lookup.ym >= reqs.start_month))
            & (reqs.end_month.isNull() | (lookup.ym <= reqs.end_month)))
    return reqs.join(lookup, cond)


def _dim_value(axis: str):
    return (F.when(F.col(axis) == "ym", F.col("ym"))
            .when(F.col(axis) == "industry", F.col("industry"))
            .otherwise(F.col("age_level")))


def _limit():
    return F.least(F.greatest(F.coalesce(F.col("topn"), F.lit(TOPN_DEFAULT)), F.lit(TOPN_MIN)), F.lit(TOPN_MAX))


def serve_sum_charts(fact: DataFrame, requests: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Points of every accepted bar / line request: ``cache_key, pos, x,
    raw_amount, y, share`` (one chart per key, chart order in ``pos``)."""
    j = _matched(fact, requests, ("bar", "line"), lookup)
    xval = _dim_value("x_axis")
    amount = F.when(F.col("value") == "trans_count", F.col("c")).otherwise(F.col("t"))
    sums = (j.groupBy("cache_key", "chart_type", "x_axis", "value", "topn", xval.alias("x"))
            .agg(F.sum(amount).alias("raw_amount")))

    by_size = (F.col("chart_type") == "bar") & (F.col("x_axis") != "ym")
    w = Window.partitionBy("cache_key").orderBy(
        F.when(by_size, -F.col("raw_amount")).otherwise(F.lit(0)), F.col("x"))
    ranked = sums.withColumn("pos", F.row_number().over(w).cast("bigint"))
    kept = ranked.where((F.col("x_axis") == "ym") | (F.col("pos") <= _limit()))

    div = F.lit(1.0)
    for metric, (d, _unit) in UNITS.items():
        div = F.when(F.col("value") == metric, F.lit(float(d))).otherwise(div)
    pts = kept.withColumn("y", round_half_even(F.col("raw_amount").cast("double") / div, 2))
    total = F.sum("y").over(Window.partitionBy("cache_key"))
    share = round_half_even(F.try_divide(F.col("y"), total), 2)
    return pts.select("cache_key", "pos", "x", "raw_amount", "y", share.alias("share"))


def serve_pie_charts(fact: DataFrame, requests: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Points of every accepted pie request: ``cache_key, pos, x, amount``
    (integer percentages, slices under 10 % folded into the "other" label)."""
    j = _matched(fact, requests, ("pie",), lookup)
    amount = F.when(F.col("value") == "trans_count", F.col("c")).otherwise(F.col("t"))
    g = (j.groupBy("cache_key", "x_axis", "topn", _dim_value("x_axis").alias("x"))
         .agg(F.sum(amount).alias("group_amount")))
    total = F.sum("group_amount").over(Window.partitionBy("cache_key"))
    pct = F.round(F.try_divide(F.col("group_amount").cast("double"), total.cast("double")) * F.lit(100.0), 0)
    s = g.select("cache_key", "x_axis", "topn", "x", pct.alias("pct"))
    s = s.withColumn("x", F.when(F.col("pct") < PIE_OTHER_BELOW_PCT, F.lit(OTHER_LABEL)).otherwise(F.col("x")))
    u = s.groupBy("cache_key", "x_axis", "topn", "x").agg(F.sum("pct").alias("amount"))
    by_label = F.col("x_axis") == "ym"
    w = Window.partitionBy("cache_key").orderBy(
        F.when(by_label, F.lit(0.0)).otherwise(-F.col("amount")).asc_nulls_last(), F.col("x"))
    ranked = u.withColumn("pos", F.row_number().over(w).cast("bigint"))
    kept = ranked.where(by_label | (F.col("pos") <= _limit()))
    label = F.when(F.col("amount") >= PIE_RELABEL_BELOW, F.col("x")).otherwise(F.lit(OTHER_LABEL))
    return kept.select("cache_key", "pos", label.alias("x"), "amount")


def serve_heatmap_charts(fact: DataFrame, requests: DataFrame, digits: int = 4,
                         lookup: DataFrame | None = None) -> DataFrame:
    """Cells of every accepted heatmap request: ``cache_key, pos, x, y,
    amount`` (average ticket, NULL for a zero count)."""
    j = _matched(fact, requests, ("heatmap",), lookup)
    g = (j.groupBy("cache_key", "x_axis", "y_axis", _dim_value("x_axis").alias("x"),
                   _dim_value("y_axis").alias("y"))
         .agg(F.sum("t").alias("num"), F.sum("c").alias("den")))
    amount = F.round(F.try_divide(F.col("num").cast("double"), F.col("den").cast("double")), digits)
    age = (F.col("x_axis") == "age_level") | (F.col("y_axis") == "age_level")
    w = Window.partitionBy("cache_key").orderBy(
        F.when(age, F.col("y")).otherwise(F.col("x")), F.when(age, F.col("x")).otherwise(F.col("y")))
    return g.select("cache_key", F.row_number().over(w).cast("bigint").alias("pos"), "x", "y",
                    amount.alias("amount"))


def result_points(fact: DataFrame, requests: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """The points document of every request that has data: ``cache_key, points_json``."""
    from ..operators.requests_log import points_document
    charts = (serve_sum_charts(fact, requests, lookup), serve_pie_charts(fact, requests, lookup),
              serve_heatmap_charts(fact, requests, lookup=lookup))
    first, *rest = [points_document(c, ["cache_key"]) for c in charts]
    for docs in rest:
        first = first.unionByName(docs)
    return first
