"""ETL: extract files -> cleaning chain -> idempotent month-partitioned table.

Also writes raw extracts in every supported layout (used to exercise the
readers on data derived from the driver tables).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.clean import ImputeReport, clean_extract
from ..sources.extracts import ingest
from ..sources.sinks import append_new_rows

ROWS_PER_DOC = 10_000  # target records per JSON document (bounds a document's size)
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copy")


def write_extract(df: DataFrame, layout: str, path: str, headers: list[str]) -> str:
    """Write a raw extract (line key columns and ``copy`` plus ``headers``).

    ``csv`` / ``lines`` are written split across tasks.  The document layouts
    (``array``, ``wrapped``, ``keyed``) become one JSON document per block,
    each in its own compressed file of one folder, which is listed at once.  Blocks
    are a hash of the unique line key over ``ceil(rows / ROWS_PER_DOC)`` buckets, so
    every document holds about ``ROWS_PER_DOC`` records however skewed the order keys are.
    Rows are dealt by block before they are gathered: gathering on both sides of
    the shuffle would sort every task's rows by block first.  What is gathered is a
    record's text, one value, not its fields.
    """
    if layout == "csv":
        df.select(*headers).write.option("header", True).csv(path)
        return path
    if layout == "lines":
        df.select(*headers).write.json(path)
        return path
    n_blocks = max(1, -(-df.count() // ROWS_PER_DOC))
    block = F.pmod(F.xxhash64(*[F.col(c) for c in LINE_KEY]), F.lit(n_blocks)).alias("block")
    record = F.to_json(F.struct(*[F.col(f"`{h}`") for h in headers])).alias("record")
    grouped = df.select(block, *headers).repartition("block").select("block", record).groupBy("block")
    docs = grouped.agg(F.collect_list("record").alias("records"))
    records = F.array_join("records", ",")
    if layout == "array":
        value = F.concat(F.lit("["), records, F.lit("]"))
    elif layout == "wrapped":
        value = F.concat(F.lit('{"meta":{"rows":'), F.size("records").cast("string"), F.lit('},"records":['), records, F.lit("]}"))
    elif layout == "keyed":
        # ids "<block>-<position>": unique within a document whatever the data
        keyed = F.transform("records", lambda r, i: F.concat(F.lit('"'), F.col("block").cast("string"), F.lit("-"), (i + 1).cast("string"), F.lit('":'), r))
        value = F.concat(F.lit("{"), F.array_join(keyed, ","), F.lit("}"))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    (docs.select(value.alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip")
         .option("zlib.compress.level", "BEST_SPEED").text(path))
    return path


def read_extract(spark: SparkSession, layout: str, path: str) -> DataFrame:
    """Read an extract written by ``write_extract``."""
    if layout == "csv":
        df = ingest(spark, "csv", path)
    else:
        df = ingest(spark, "json", path, layout={"lines": "lines", "array": "array",
                                                 "wrapped": "wrapped", "keyed": "keyed"}[layout])
    return df.drop("block") if "block" in df.columns else df


@dataclass
class EtlResult:
    appended: int
    report: ImputeReport


def run_etl(spark: SparkSession, source: str, path: str, table_path: str,
            thousands: str = "strip", median: str = "exact", **read_options) -> EtlResult:
    """Read (``csv`` or ``json``), clean, and append the rows not yet in
    the table.  Re-running with the same input appends nothing."""
    report = ImputeReport()
    raw = ingest(spark, source, path, **read_options)
    if "block" in raw.columns:
        raw = raw.drop("block")
    clean = clean_extract(raw, thousands=thousands, median=median, report=report)
    n = append_new_rows(spark, clean, table_path)
    return EtlResult(appended=n, report=report)
