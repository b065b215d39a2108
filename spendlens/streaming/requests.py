"""Chart requests as they arrive: keyed state for first requests, a log
without repeated deliveries, and the latest status of every result.

Three streaming queries read the same folder of request files; each can be
stopped, restarted or replayed on its own.

* ``track_firsts`` keeps, per cache key, the first request and nothing else:
  a streaming aggregation in update mode.  Its map-side partial results make a key
  that fills a third of a batch one row per task, and its minimum over the packed
  ``(create_at, id)`` is the same in whatever order or however often requests arrive,
  so a late request moves the first back and a replayed one changes nothing.
  Every batch writes the keys that changed to a folder of its own number.
* ``append_log`` stores each request once.  A batch is anti-joined on its ids with
  the stored days it touches; replaced folders make a replayed batch harmless.
* ``track_status`` keeps, per key, the latest status by time, in the same way.

Reading back takes the least first (or the latest status) per key over the
batches' folders; ``compact`` writes that down as one.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.requests_log import id_of, order_key, validate, with_fingerprint

#: States of a result in the order they follow each other at one time.
STATUSES = ("PENDING", "READY", "FAILED")
_KEY = "cache_key string, first decimal(38,0)"
_STATUS = "cache_key string, latest string"


def accepted_requests(requests: DataFrame) -> DataFrame:
    """Requests that break no rule, with their cache key (row by row, batch or stream)."""
    return validate(with_fingerprint(requests)).where("accepted").drop("accepted", "error_codes")


def request_files(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The stream of a folder of parquet files, so many files a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def _run(stream: DataFrame, mode: str, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def _to_batch_folder(path: str):
    """Writes a batch's rows to ``batch=<number>``, in place of what a failed attempt left there."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


# -- first requests ----------------------------------------------------------------

def track_firsts(requests: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the first request of every key of a stream of accepted requests."""
    ntz = requests.schema["create_at"].dataType.typeName() == "timestamp_ntz"
    firsts = requests.groupBy("cache_key").agg(F.min(order_key(ntz=ntz)).alias("first"))
    return _run(firsts, "update", _to_batch_folder(path), checkpoint, available_now)


def firsts(spark: SparkSession, path: str) -> DataFrame:
    """``cache_key, first_id`` as of the batches written so far."""
    held = _rows(spark, path, _KEY).groupBy("cache_key").agg(F.min("first").alias("first"))
    return held.select("cache_key", id_of(F.col("first")).alias("first_id"))


# -- the log -----------------------------------------------------------------------

def append_log(requests: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stores each request of a stream once, by day.

    A request delivered again has the same id and time, hence the same day: only
    the days of the batch are read for the anti join, as a partition filter.  A
    batch tried again finds what its first attempt committed."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["id"]).withColumn("day", F.to_date("create_at"))
        stored = _log_rows(spark, path, fresh.schema)
        if stored is not None:
            low, high, undated = fresh.agg(F.min("day"), F.max("day"), F.bool_or(F.col("day").isNull())).first()
            days = F.col("day").between(low, high) if low is not None else F.lit(False)
            days = days | F.col("day").isNull() if undated else days
            fresh = fresh.join(stored.where(days).select("id"), "id", "left_anti")
        fresh.select(*batch.columns, "day").write.mode("append").partitionBy("day").parquet(path)

    return _run(requests, "append", write, checkpoint, available_now)


def _log_rows(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def marked_log(spark: SparkSession, log_path: str, firsts_path: str) -> DataFrame:
    """R2 over the streamed log: every request with ``cache_hit`` and ``result_id``."""
    first = firsts(spark, firsts_path)
    log = spark.read.parquet(log_path).drop("day")
    return log.join(first, "cache_key").select(*[F.col(c) for c in log.columns], (F.col("id") != F.col("first_id")).alias("cache_hit"),
                                               F.col("first_id").alias("result_id"))


# -- statuses ------------------------------------------------------------------------

def status_order(at: str = "at", status: str = "status") -> Column:
    """Text that orders status events: by time, and at one time by ``STATUSES``; it ends in the status."""
    rank = sum((F.when(F.col(status) == s, k).otherwise(0) for k, s in enumerate(STATUSES)), F.lit(0))
    return F.concat(F.lpad(F.unix_micros(F.col(at).cast("timestamp")).cast("string"), 20, "0"), rank.cast("string"), F.col(status))


def latest_status(events: DataFrame) -> DataFrame:
    """R4 over time: ``cache_key, status, at`` of the latest event of each key.

    ``events``: ``cache_key, status, at`` (times from 1970 on).  A maximum, so repeated and late events change nothing."""
    return _named(events.groupBy("cache_key").agg(F.max(status_order()).alias("latest")))


def _named(latest: DataFrame) -> DataFrame:
    return latest.select("cache_key", F.substring("latest", 22, 20).alias("status"),
                         F.timestamp_micros(F.substring("latest", 1, 20).cast("long")).alias("at"))


def track_status(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the latest status of every key of a stream of events."""
    return _run(events.groupBy("cache_key").agg(F.max(status_order()).alias("latest")), "update", _to_batch_folder(path), checkpoint, available_now)


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """``cache_key, status, at`` as of the batches written so far."""
    return _named(_rows(spark, path, _STATUS).groupBy("cache_key").agg(F.max("latest").alias("latest")))


def compact(spark: SparkSession, path: str, to: str, kind: str = "firsts") -> str:
    """Writes what the batches' folders say as one table at ``to``."""
    schema, column, pick = (_KEY, "first", F.min) if kind == "firsts" else (_STATUS, "latest", F.max)
    _rows(spark, path, schema).groupBy("cache_key").agg(pick(column).alias(column)).write.mode("overwrite").parquet(to)
    return to
