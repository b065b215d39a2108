"""Cleaning chain for raw extracts.

Order: rename -> required columns -> project -> parse numbers -> impute
(median for numbers, mode for text) -> drop exact duplicates -> final types.
Imputation runs before de-duplication, so copies weigh on the statistics and
rows made equal by imputation collapse.
"""
from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.numbers import literal_value
from ..schema import FACT_COLUMNS, HEADER_MAP, METRIC_COLUMNS, TEXT_COLUMNS
from .quantiles import approx_medians, bracket_exprs, exact_medians, middle_values

log = logging.getLogger(__name__)


#: Amounts from here on do not fit a bigint.
BIGINT_BOUND = 2.0 ** 63


def rename_headers(df: DataFrame, mapping: dict[str, str] = HEADER_MAP) -> DataFrame:
    """Source headers -> canonical names; unknown columns are kept as is."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def require_columns(df: DataFrame, expected=FACT_COLUMNS) -> DataFrame:
    """Every expected column must exist; lists missing and present ones."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; present: {df.columns}")
    return df


def project(df: DataFrame, expected=FACT_COLUMNS) -> DataFrame:
    """Keep the expected columns, in order."""
    return df.select(*expected)


def parse_metrics(df: DataFrame, cols=METRIC_COLUMNS, thousands: str = "strip") -> DataFrame:
    """C4: metric text -> double (unparsable -> NULL).  A number that no
    ``bigint`` can hold counts as missing, like one that cannot be parsed.
    Numbers are a projection of their own, so a text is parsed once for its
    bound and its value."""
    numbers = df.withColumns({c: literal_value(F.col(c), thousands) for c in cols})
    return numbers.withColumns({c: F.when(F.abs(F.col(c)) < F.lit(BIGINT_BOUND), F.col(c)) for c in cols})


def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, missing_ratio)`` for each column, from one aggregate."""
    cols = cols or df.columns
    agg = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return agg.unpivot([], cols, "column", "missing_ratio")


def mode_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, value``: the most frequent value per text column, ties ->
    smallest, NULLs skipped; no row for a column without values.

    One job for all columns: values are unpivoted to (column, value) and
    counted with a partial aggregation (a hot value collapses map-side), then
    each column keeps the value with the largest count.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = (df.select(F.explode(pairs).alias("p")).select("p.*")
              .where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("value"))).alias("b"))
    return best.select("column", "b.value")


def text_modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """``mode_rows`` as a dictionary, ``None`` for a column without values."""
    if not cols:
        return {}
    found = {r["column"]: r["value"] for r in mode_rows(df, cols).collect()}
    return {c: found.get(c) for c in cols}


def fill_values(df: DataFrame, num_cols: list[str], str_cols: list[str]) -> DataFrame:
    """One row with the median of each number column and the mode of
    each text column.  The driver learns between which two values a
    median lies; the median itself is aggregated from the table."""
    def median(c: str, pair) -> Column:
        if pair is None:
            return F.lit(None).cast("double").alias(c)
        v = F.col(c).cast("double")
        middle = F.when(v.between(F.lit(pair[0]), F.lit(pair[1])), v)
        low, high = F.min(middle), F.max(middle)
        return F.when(low == high, low).otherwise((low + high) / 2).alias(c)

    medians = df.agg(*[median(c, pair) for c, pair in middle_values(df, num_cols).items()])
    modes = mode_rows(df, str_cols)
    return medians.select("*", *[modes.where(F.col("column") == c).select("value").scalar().alias(c) for c in str_cols])


@dataclass
class ImputeReport:
    missing_ratio: dict[str, float] = field(default_factory=dict)
    fill_values: dict[str, object] = field(default_factory=dict)


def _present(c: str, num_cols) -> Column:
    """The value when present; a NaN in a number column counts as missing."""
    if c in num_cols:
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v)
    return F.col(c)


def impute_stats_exprs(num_cols, str_cols) -> list[Column]:
    """Aggregates the imputation needs: rows, present values per column,
    a bracket around the middle per number column."""
    cols = list(num_cols) + list(str_cols)
    return ([F.count(F.lit(1)).alias("__rows")]
            + [F.count(_present(c, num_cols)).alias(c) for c in cols]
            + bracket_exprs(num_cols))


def impute(df: DataFrame, num_cols=METRIC_COLUMNS, str_cols=TEXT_COLUMNS,
           median: str = "exact", report: ImputeReport | None = None,
           stats: dict | None = None) -> DataFrame:
    """Fill missing numbers with the column median and missing text
    with the column mode -- only for columns that have missing values.  A
    column without any value (no median / mode) is left missing.

    The statistics are computed with a few small aggregate jobs and applied
    as literals; the returned DataFrame stays lazy.  ``stats`` (the values of
    ``impute_stats_exprs``, e.g. observed while the rows were written) saves
    the first of those jobs.
    """
    num_cols = [c for c in num_cols if c in df.columns]
    str_cols = [c for c in str_cols if c in df.columns]
    cols = num_cols + str_cols
    if not cols:
        return df
    if not stats or "__rows" not in stats:
        stats = df.agg(*impute_stats_exprs(num_cols, str_cols)).first().asDict()
    rows = stats["__rows"]
    ratio = {c: (1.0 - stats[c] / rows) if rows else 0.0 for c in cols}
    need_num = [c for c in num_cols if ratio[c] > 0]
    need_str = [c for c in str_cols if ratio[c] > 0]
    fills: dict[str, object] = {}
    if need_num:
        if median == "exact":
            fills.update(exact_medians(df, need_num, {c: stats[f"__mid_{c}"] for c in need_num}))
        else:
            fills.update(approx_medians(df, need_num))
    if need_str:
        fills.update(text_modes(df, need_str))
    for c in need_num + need_str:
        log.info("%s missing %.2f%%, fill %r", c, ratio[c] * 100, fills.get(c))
    if report is not None:
        report.missing_ratio.update(ratio)
        report.fill_values.update(fills)
    repl = {c: F.coalesce(_present(c, num_cols), F.lit(v)) for c, v in fills.items() if v is not None}
    return df.withColumns(repl) if repl else df


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Drop rows equal on every column (partial de-duplication runs
    map-side, so a row copied a million times is collapsed before the
    shuffle)."""
    return df.dropDuplicates()


def duplicate_stats(df: DataFrame) -> DataFrame:
    """One row ``(rows_before, rows_after, duplicates)`` in one job."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(F.sum("__n").cast("bigint").alias("rows_before"),
                 F.count(F.lit(1)).alias("rows_after")).select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("duplicates"))


def final_types(df: DataFrame) -> DataFrame:
    """Text columns as string, metrics as bigint (truncating; NULL where none fits)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in TEXT_COLUMNS],
                     *[F.col(c).try_cast("bigint").alias(c) for c in METRIC_COLUMNS])


def parsed_extract(df: DataFrame, thousands: str = "strip") -> DataFrame:
    """C1 -> C2 -> C3 -> C4."""
    return parse_metrics(project(require_columns(rename_headers(df))), thousands=thousands)


def clean_extract(df: DataFrame, thousands: str = "strip", median: str = "exact",
                  report: ImputeReport | None = None, materialize: bool = True) -> DataFrame:
    """C11: the full chain, C1 -> C2 -> C3 -> C4 -> C5/C6 -> C8 -> C10.

    ``materialize`` (default) writes the parsed rows once as parquet in the
    shared checkpoint folder before the statistics passes: the raw input is
    read and parsed once instead of once per pass, each pass reads only the
    columns it needs, and the lineage is cut (an executor loss re-reads the
    written table instead of re-running the extract).  The first statistics
    (counts, brackets of the medians) are observed during that write; after it
    one pass counts, one ranks the values in the brackets, and one finds modes.
    """
    parsed = parsed_extract(df, thousands)
    stats = None
    if materialize:
        from ..config import shared_path, write_table
        # The imputation statistics are observed while the rows are written.
        obs = Observation("parsed_extract_stats")
        observed = parsed.observe(obs, *impute_stats_exprs(METRIC_COLUMNS, TEXT_COLUMNS))
        parsed = write_table(observed, shared_path(df.sparkSession, "parsed-extract"))
        try:
            stats = obs.get
        except Exception:  # noqa: BLE001 -- metrics pruned with an empty plan
            stats = None
    filled = impute(parsed, median=median, report=report, stats=stats)
    return final_types(drop_exact_duplicates(filled))
