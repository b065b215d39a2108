"""Sinks: month-partitioned fact tables and idempotent appends."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from ..config import shared_path, write_table
from ..schema import FACT_COLUMNS, FACT_SCHEMA

#: Text of a month that is none; such rows share the folder of rows without a month.
MONTH_TEXT = "ym_text"
#: Columns that files are clustered by inside a month, and the size such a file is meant to have.
CLUSTERED_BY = ("industry", "age_level")
CLUSTERED_FILE_BYTES = 128 << 20
#: Bytes of rows, as they are in memory, that one task sorts for such a file, and of one row:
#: 16 per column and 24 per text, besides 32 for its place in the sort.
SORTED_RUN_BYTES = 256 << 20
_ROW_BYTES = 32 + 16 * (len(FACT_COLUMNS) + 1) + 24 * 4
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # the folder's name is fixed by Spark


def write_fact(df: DataFrame, path: str, mode: str = "append",
               partition_by: str = "ym") -> None:
    """Write a fact DataFrame as parquet partitioned by month.

    ``rebalance`` lets AQE size the write tasks: a month holding a third of
    all rows is split over several tasks/files instead of one, and small
    months are coalesced instead of producing a file per input task.  A month that
    is not ``YYYYMM`` makes no folder of its own: its text is kept beside the row.
    """
    if partition_by == "ym":
        df = _with_folder(df)
    (df.hint("rebalance", partition_by)
       .write.mode(mode).partitionBy(partition_by).parquet(path))


def _with_folder(df: DataFrame) -> DataFrame:
    """The month as its folder has it, and the text of a month that is none."""
    valid = F.col("ym").rlike("^[0-9]{6}$")
    return df.withColumn(MONTH_TEXT, F.when(~valid, F.col("ym"))).withColumn("ym", F.when(valid, F.col("ym")))


def write_clustered_fact(df: DataFrame, path: str, files: int, mode: str = "overwrite") -> None:
    """write a fact so that a file holds few industries and age bands of a month.

    Rows are range-partitioned into about ``files`` runs of the order (month,
    industry, age band) and sorted in it, so the statistics of files and row
    groups are narrow and a filter on either column skips the others; the Bloom
    filters serve values that lie between a group's least and greatest.  A
    (month, industry, age band) with more rows than a run is cut by a hash of its
    row; only copies of one row, which appends collapse, stay together.
    """
    rows = _with_folder(df)
    order = [F.col("ym"), F.col("industry"), F.col("age_level")]
    runs = rows.repartitionByRange(max(1, files), *order, F.xxhash64(*rows.columns)).sortWithinPartitions(*order)
    w = runs.write.mode(mode).partitionBy("ym")
    for c in CLUSTERED_BY:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "1000")
    w.parquet(path)


def cluster_fact(spark: SparkSession, path: str, out: str, file_bytes: int = CLUSTERED_FILE_BYTES) -> str:
    """Rewrite the fact at ``path``, as appends have left it, in clustered files
    of about ``file_bytes`` at ``out``, or of the rows that a task sorts within
    ``SORTED_RUN_BYTES`` where that is less: stored rows are many times smaller than
    sorted ones, so files of one size hold more rows the more these repeat.  Their
    number comes from the size of the listed files and from footers; no row is read for it."""
    stored = spark.read.schema(FACT_SCHEMA).parquet(path)
    size = int(str(stored._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    in_memory = stored.count() * _ROW_BYTES
    write_clustered_fact(read_fact(spark, path), out, max(-(-size // file_bytes), -(-in_memory // SORTED_RUN_BYTES)))
    return out


def has_other_months(spark: SparkSession, path: str) -> bool:
    """Whether a fact holds rows without a valid month."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"ym={_NO_MONTH}")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """Read a month-partitioned fact table with its declared schema (the
    partition column stays text instead of being inferred as a number).

    Rows without a valid month, if there are any, are a branch of their own, so
    that month filters prune folders in the other one."""
    if not has_other_months(spark, path):
        return spark.read.schema(FACT_SCHEMA).parquet(path).select(*FACT_COLUMNS)
    schema = T.StructType([*FACT_SCHEMA.fields, T.StructField(MONTH_TEXT, T.StringType())])
    rows = spark.read.schema(schema).parquet(path)
    other = [F.col(MONTH_TEXT).alias("ym") if c == "ym" else F.col(c) for c in FACT_COLUMNS]
    return rows.where("ym is not null").select(*FACT_COLUMNS).unionByName(rows.where("ym is null").select(*other))


def _read_existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_fact(spark, path)
    except AnalysisException:
        return None


def append_new_rows(spark: SparkSession, df: DataFrame, path: str,
                    keys: list[str] | None = None, partition_by: str = "ym") -> int:
    """Append only rows not already stored (an idempotent re-run appends
    nothing).  Copies inside ``df`` are collapsed first; rows are compared on
    ``keys`` (default: all fact columns) with NULL-safe equality.

    The anti join against the stored table is a shuffle join at scale.  The
    stored table is read only for the range of months in ``df``: the least and
    greatest are observed while the incoming rows are stored, once, in the shared
    folder, and become a partition filter, because Spark's dynamic pruning does
    not apply to the build side of an anti join.
    Returns the number of appended rows (measured during the write through
    an ``Observation``, no extra pass).  Empty input is a no-op.
    """
    keys = keys or [c for c in FACT_COLUMNS if c in df.columns]
    incoming = df.dropDuplicates()
    existing = _read_existing(spark, path)
    if existing is not None and partition_by in keys:
        # The incoming rows are worked out once: stored, with their range observed on the way.
        months = [F.min(partition_by).alias("least"), F.max(partition_by).alias("most"),
                  F.bool_or(F.col(partition_by).isNull()).alias("missing")]
        seen = Observation("incoming_months")
        incoming = write_table(incoming.observe(seen, *months), shared_path(spark, "incoming-rows"))
        try:
            found = seen.get
        except Exception:  # noqa: BLE001 -- metrics pruned with an empty plan
            found = {}
        least, most, missing = (found[c] for c in ("least", "most", "missing")) if "least" in found else incoming.agg(*months).first()
        keep = F.col(partition_by).between(least, most) if least is not None else F.lit(False)
        if missing:
            keep = keep | F.col(partition_by).isNull()
        existing = existing.where(keep)
    if existing is not None:
        ex = existing.select(*[F.col(k).alias(f"__ex_{k}") for k in keys])
        cond = reduce(lambda a, b: a & b,
                      [incoming[k].eqNullSafe(ex[f"__ex_{k}"]) for k in keys])
        incoming = incoming.join(ex, cond, "left_anti")
    obs = Observation("append_new_rows")
    observed = incoming.observe(obs, F.count(F.lit(1)).alias("rows"))
    write_fact(observed, path, mode="append", partition_by=partition_by)
    try:
        return int(obs.get.get("rows", 0))
    except Exception:  # noqa: BLE001
        # AQE replaces a provably empty plan (nothing new to append) by an
        # empty relation, so no metrics are reported.
        return 0
