"""State of a month-partitioned table, kept month by month.

A table that only grows (``sources.sinks.append_new_rows``) touches few
months at a time.  What is derived from it per month -- the serving lookup,
quantile sketches, value counts -- is stored by month beside the number of
rows it was derived from.  ``refresh_by_month`` compares these numbers with those in
the table's parquet footers, derives the months that differ anew, and replaces
them; no row of another month is read.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import FACT_SCHEMA, METRIC_COLUMNS, TEXT_COLUMNS

#: Accuracy parameter of the sketches (rank error about 0.1 %) and the distance, well above that
#: error, of a bracket's ends from the middle.
SKETCH_K, SKETCH_BRACKET = 4095, 0.003


def in_months(months: list[str | None]) -> Column:
    """Whether a row's month is one of the given (a partition filter)."""
    some = [m for m in months if m is not None]
    cond = F.col("ym").isin(some) if some else F.lit(False)
    return cond | F.col("ym").isNull() if None in months else cond


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("inferSchema", False).parquet(path).withColumn("ym", F.col("ym").cast("string"))
    except AnalysisException:
        return None


def touched_months(spark: SparkSession, table_path: str, state_path: str, schema=FACT_SCHEMA) -> tuple[list[str | None], DataFrame]:
    """Months whose row count differs from what the state was derived from, and all months' counts."""
    from ..sources.tables import stored_months
    months = stored_months(spark, table_path, schema)
    known = _read(spark, f"{state_path}/months")
    if known is None:
        changed = months
    else:
        known = known.select(F.col("ym").alias("k_ym"), F.col("rows").alias("k_rows"))
        changed = months.join(known, F.col("ym").eqNullSafe(F.col("k_ym")) & (F.col("rows") == F.col("k_rows")), "left_anti")
    # At most one row per calendar month.
    return sorted((r["ym"] for r in changed.select("ym").collect()), key=lambda m: (m is None, m)), months


def refresh_by_month(spark: SparkSession, table_path: str, state_path: str, build: Callable[[DataFrame], DataFrame],
                     schema=FACT_SCHEMA) -> tuple[DataFrame, list[str | None]]:
    """The state of the table (``build`` of its rows, which must keep ``ym``), and the months derived anew.

    The months' counts are written last: a refresh that fails on the way is
    simply done again.  Rows must not be taken out of the table; a table that was
    rewritten needs a new ``state_path``."""
    touched, months = touched_months(spark, table_path, state_path, schema)
    if touched:
        rows = spark.read.schema(schema).parquet(table_path).where(in_months(touched))
        (build(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(f"{state_path}/rows"))
        months.write.mode("overwrite").parquet(f"{state_path}/months")
    return _read(spark, f"{state_path}/rows"), touched


# -- fill values of a growing table (C5, C6) ------------------------------------

def month_statistics(rows: DataFrame, num_cols=METRIC_COLUMNS, str_cols=TEXT_COLUMNS) -> DataFrame:
    """``ym, column, value, n, sketch``: per month the counts of each text value, and one
    mergeable sketch of each number column (``value`` and ``n`` then are NULL and the present values)."""
    present = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    sketched = rows.groupBy("ym").agg(*[F.struct(F.count(present(c)).alias("n"), F.kll_sketch_agg_double(present(c), F.lit(SKETCH_K)).alias("sketch")).alias(c)
                                        for c in num_cols])
    numbers = (sketched.select("ym", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in num_cols])).alias("p"))
               .select("ym", "p.column", F.lit(None).cast("string").alias("value"), "p.s.n", "p.s.sketch"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in str_cols])
    texts = (rows.select("ym", F.explode(pairs).alias("p")).select("ym", "p.column", "p.value").where("value is not null")
             .groupBy("ym", "column", "value").agg(F.count("*").alias("n")).withColumn("sketch", F.lit(None).cast("binary")))
    return numbers.unionByName(texts)


def fill_values_by_month(spark: SparkSession, table_path: str, state_path: str, schema, num_cols=METRIC_COLUMNS,
                         str_cols=TEXT_COLUMNS) -> tuple[dict[str, object], list[str | None]]:
    """C5, C6 over a growing table: the exact median of each number column and the mode of each text
    column, and the months whose statistics were derived anew.

    Modes come from the stored counts alone.  A median starts from a bracket merged from the
    stored sketches, so no old month is read for it; the ranks within are then counted exactly."""
    from .quantiles import exact_medians
    state, touched = refresh_by_month(spark, table_path, state_path, lambda rows: month_statistics(rows, num_cols, str_cols), schema)
    ends = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in (0.5 - SKETCH_BRACKET, 0.5 + SKETCH_BRACKET)]
    merged = (state.where("sketch is not null and n > 0").groupBy("column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
              .select("column", F.array(*ends).alias("ends")))
    brackets = {r["column"]: list(r["ends"]) for r in merged.collect()}
    fills: dict[str, object] = dict(exact_medians(spark.read.schema(schema).parquet(table_path), list(num_cols), {c: brackets.get(c) for c in num_cols}))
    counts = state.where("sketch is null").groupBy("column", "value").agg(F.sum("n").alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("value"))).alias("b"))
    modes = {r["column"]: r["value"] for r in best.select("column", "b.value").collect()}
    fills.update({c: modes.get(c) for c in str_cols})
    return fills, touched
