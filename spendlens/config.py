"""Session construction and shared-storage helpers."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings that matter at scale; all are plain Spark configuration.
SCALE_CONF = {
    # AQE re-plans at runtime: coalesces small shuffle partitions, converts
    # sort-merge joins to broadcast when a side turns out small, and splits
    # skewed partitions of a join.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcasts only happen behind Catalyst's size estimate; 32 MB keeps
    # dimension tables broadcast and forces shuffle joins for anything bigger.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # Month-partitioned writes: one file per ym per task at most.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "spendlens", driver_memory: str = "8g") -> SparkSession:
    """Create (or reuse) a session with the scale settings applied.

    On a cluster ``master`` stays ``None`` so spark-submit decides.  In local
    mode the driver JVM runs every task, so its heap is set explicitly
    (Spark's default is 1 GB).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it (a shared file system / object store path).  Only when
    it is unset -- local runs and tests -- a private folder is created.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- no SparkContext (e.g. Spark Connect)
        sc = None
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="spendlens-ckpt-")
    if sc is None:
        return d
    current = sc.getCheckpointDir()
    if not current or d.split("://")[-1].strip("/") not in current:
        sc.setCheckpointDir(d)
        current = sc.getCheckpointDir()
    return current or d


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python code can open a local path (tests)."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


def write_table(df, path: str, partition_by: str | None = None):
    """Write ``df`` as parquet at ``path`` (overwrite) and return a reader
    of it -- a lineage cut that survives executor loss, unlike a local
    checkpoint."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


# Up to so many files are told apart one by one; more by their names, their size together and their folders' marks.
LISTED_FILES = 64


def path_mark(spark: SparkSession, path: str) -> str | None:
    """What tells the state of a table from one file status: the time of the
    ``_SUCCESS`` file that every committed write renews, or of a single file.
    None for a folder without one."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(where)
    if status.isFile():
        return f"{status.getLen()}@{status.getModificationTime()}"
    done = jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")
    return f"done@{fs.getFileStatus(done).getModificationTime()}" if fs.exists(done) else None


def data_version(*tables) -> str:
    """A hash of the files behind the given file-based DataFrames.

    It comes from the listing the DataFrame already holds and from file
    statuses; no Spark job runs and no column is read."""
    import hashlib

    seen = hashlib.sha256()
    for df in tables:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for k in range(leaves.size()):
            location = leaves.apply(k).relation().location()
            names = location.inputFiles()
            seen.update(f"{len(names)},{location.sizeInBytes()}".encode())
            if len(names) <= LISTED_FILES:
                files = location.allFiles()
                each = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in (files.apply(i) for i in range(files.size())))
                seen.update(repr(each).encode())
                continue
            seen.update(str(location.allFiles().hashCode()).encode())  # of the paths
            roots = location.rootPaths()
            for i in range(roots.size()):
                seen.update(str(path_mark(df.sparkSession, roots.apply(i).toString())).encode())
    return seen.hexdigest()[:16]


def session_table(spark: SparkSession, name: str, source: str, build) -> "DataFrame":  # noqa: F821
    """A derived table written once per session and state of its source.

    ``build()`` returns the DataFrame to store; its location is remembered
    in the session configuration under ``spendlens.table.<name>`` together
    with ``source``, so later calls for the same source read it back.
    ``source`` must name the state of the data (see ``data_version``), not
    only its place: a table of rewritten or appended data is built anew.
    """
    key = f"spendlens.table.{name}"
    stored = spark.conf.get(key, None)
    if stored:
        src, _, path = stored.partition("|")
        if src == source:
            return spark.read.parquet(path)
    path = shared_path(spark, name)
    df = write_table(build(), path)
    spark.conf.set(key, f"{source}|{path}")
    return df
