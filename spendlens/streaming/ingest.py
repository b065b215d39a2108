"""Incremental extract ingest: file-source stream -> row-level cleaning ->
idempotent append into the month-partitioned fact table.

Only the row-level steps of the cleaning chain run in the stream (header
mapping, missing tokens, number parsing, final types); median / mode
imputation needs statistics over the whole table and stays a batch step
(``operators.clean.impute`` over the table).  Each micro-batch writes its
cleaned rows to a staging folder of its own number inside ``foreachBatch``, in
place of what a failed attempt left there.  Staged rows are de-duplicated and
anti-joined against the stored table, so a batch replayed after a failure appends
nothing twice.  A stream that goes on does so in every batch.  One that catches
up does so when the staged rows take as many bytes as the table, and at its end: the
table is read as often as it doubles, not once a batch.

A CSV stream is a stream of file names: each batch's files are read by the batch
reader, which matches columns by each file's own header, so files may name
their columns in any order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.clean import final_types, parse_metrics, project, rename_headers, require_columns
from ..schema import FACT_SCHEMA, NA_TOKENS, RAW_SCHEMA
from ..sources.extracts import read_csv_extract
from ..sources.sinks import append_new_rows

#: Files of one micro-batch unless stated: so many names at most reach the driver.
FILES_PER_BATCH = 1000


def clean_stream(raw: DataFrame, thousands: str = "strip") -> DataFrame:
    """Row-level cleaning of a raw (text) stream or batch."""
    toks = [F.lit(t) for t in NA_TOKENS]
    no_na = raw.select(*[F.when(F.col(f"`{c}`").isin(*toks), F.lit(None))
                          .otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    parsed = parse_metrics(project(require_columns(rename_headers(no_na))), thousands=thousands)
    return final_types(parsed)


class IngestQuery:
    """The running ingest, as a streaming query; rows that are still staged when
    it has ended are appended by whoever waits for that."""

    def __init__(self, query, flush):
        self._query, self._flush = query, flush

    def __getattr__(self, name):
        return getattr(self._query, name)

    def awaitTermination(self, timeout: int | None = None):
        ended = self._query.awaitTermination(timeout)
        if timeout is None or ended:
            self._flush()
        return ended

    def processAllAvailable(self) -> None:
        self._query.processAllAvailable()
        self._flush()


def _stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a folder, by its listing; none if it does not exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def flush_staged(spark: SparkSession, staged: str, table_path: str) -> None:
    """Append the staged rows that the table does not hold, then empty the staging
    folder.  Stopped in between, it finds nothing new the next time."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return
    append_new_rows(spark, spark.read.schema(FACT_SCHEMA).option("recursiveFileLookup", True).parquet(staged), table_path)
    fs.delete(where, True)


def ingest_stream(spark: SparkSession, source_dir: str, table_path: str, checkpoint_path: str,
                  fmt: str = "csv", thousands: str = "strip", available_now: bool = True,
                  max_files_per_trigger: int | None = None):
    """Start the ingest query; with ``available_now`` it processes every file
    present and stops (call ``.awaitTermination()`` on the result, which also
    appends what is still staged; if nobody does, the next run will)."""
    files_per_batch = max_files_per_trigger or FILES_PER_BATCH
    staged = f"{checkpoint_path.rstrip('/')}-staged"
    if fmt == "csv":
        # The contents are not read here: only the paths are asked for.
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        stream = files.option("maxFilesPerTrigger", files_per_batch).load(source_dir).select("path")
    elif fmt == "json":
        stream = clean_stream(spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source_dir), thousands)
    else:
        raise ValueError("fmt must be 'csv' or 'json'")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if fmt == "csv":
            files = sorted(r["path"] for r in batch.collect())
            if not files:
                return
            rows = clean_stream(read_csv_extract(batch.sparkSession, files), thousands)
        rows.write.mode("overwrite").parquet(f"{staged}/batch={batch_id}")
        if not available_now or _stored_bytes(spark, staged) >= _stored_bytes(spark, table_path):
            flush_staged(spark, staged, table_path)

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return IngestQuery(w.start(), lambda: flush_staged(spark, staged, table_path))
