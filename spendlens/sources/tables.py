"""The driver's parquet tables and the card-spend fact derived from them."""
from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import AGE_FIRST_LABEL, FACT_COLUMNS, FACT_SCHEMA

# Session keys naming a materialised fact table (see ``materialize_fact``).
FACT_PATH_KEY = "spendlens.fact.path"
FACT_SOURCE_KEY = "spendlens.fact.source"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Largest dimension (bytes: rows times the schema's default width) joined by
# broadcast; above it the join shuffles.  A row bound may be set besides.
BROADCAST_MAX_ROWS_KEY = "spendlens.broadcast.maxRows"
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20


def _row_width(df: DataFrame) -> int:
    """Bytes of a row by declared type: 8 per number, 20 per text, 8 per row."""
    return 8 + sum(20 if f.dataType.typeName() in ("string", "binary") else 8 for f in df.schema)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` only when its rows and bytes are within the bounds.

    ``rows`` comes from the driving table's parquet footers (a metadata-only
    count).  Above the bound no hint is given and Catalyst / AQE plan a
    shuffle join.  Without row statistics Catalyst estimates a join's size as
    the product of its inputs, so the hint is what keeps a small joined
    dimension on the build side instead of the fact table.
    """
    limit = int(df.sparkSession.conf.get(BROADCAST_MAX_ROWS_KEY, str(BROADCAST_MAX_ROWS)))
    return F.broadcast(df) if rows <= limit and rows * _row_width(df) <= BROADCAST_MAX_BYTES else df


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan that arrives in fewer partitions than there are cores.

    A table stored as one file with one row group is read by a single task,
    and every narrow operator after it (broadcast joins, projections) stays
    in that task.  Such a scan is redistributed round-robin over the cores.
    Real fact-sized inputs are split into far more partitions than cores,
    so there this is a no-op (only file metadata is consulted).
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 -- no RDD access (e.g. Spark Connect)
        return df
    return df.repartition(cores) if parts * 2 <= cores else df


def age_band(p_size):
    """Age band label derived from the part size (fixture rule)."""
    return (F.when(p_size < 20, F.lit(AGE_FIRST_LABEL))
            .when(p_size < 30, F.lit("20(含)-30歲"))
            .when(p_size < 40, F.lit("30(含)-40歲"))
            .otherwise(F.lit("40(含)歲以上")))


def _in_months(lines: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Lines shipped in a range of months, as a range of dates: a condition on
    the stored column, so it reaches the parquet scan."""
    if start is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(date(int(start[:4]), int(start[4:]), 1)))
    if end is not None:
        year, month = int(end[:4]) + int(end[4:]) // 12, int(end[4:]) % 12 + 1
        lines = lines.where(F.col("l_shipdate") < F.lit(date(year, month, 1)))
    return lines


def fact_lines(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Fact rows plus the line identity (order, line number, part, supplier).

    Join order is chosen for scale: the per-order attributes (customer
    segment, nation) are attached to ``orders`` first, so ``lineitem`` -- the
    only table that grows without bound -- is shuffled once for the order
    join and once for the part join.  Every input is pruned to the columns
    used before it is joined; Catalyst broadcasts a side only when its
    estimated size is under the broadcast threshold, and AQE may switch to a
    broadcast at runtime once a side is measured small.  Month bounds
    (``YYYYMM``) limit the lines read.
    """
    li = widen(_in_months(read_table(spark, sf_dir, "lineitem"), start, end).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_shipdate"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")

    # Row bounds from parquet footers (no data read).  A buyer row per order
    # at most: orders -> customer -> nation are many-to-one.
    n_orders = read_table(spark, sf_dir, "orders").count()
    n_parts = read_table(spark, sf_dir, "part").count()
    buyers = broadcast_if_small(
        orders.join(cust, orders.o_custkey == cust.c_custkey)
              .join(nation, cust.c_nationkey == nation.n_nationkey)
              .select("o_orderkey", "n_name", "c_mktsegment"), n_orders)
    part = broadcast_if_small(part, n_parts)
    lines = (li.join(buyers, li.l_orderkey == buyers.o_orderkey)
               .join(part, li.l_partkey == part.p_partkey))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format("l_shipdate", "yyyyMM").alias("ym"),
        F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("industry"),
        age_band(F.col("p_size")).alias("age_level"),
        F.col("l_quantity").cast("bigint").alias("trans_count"),
        F.round("l_extendedprice").cast("bigint").alias("trans_total"),
    )


def fact_from_tables(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The six-column fact derived from the driver tables."""
    return fact_lines(spark, sf_dir, start, end).select(*FACT_COLUMNS)


def materialize_fact(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Write the fact once as parquet partitioned by month and register it in
    the session, so later ``fact_table`` calls for the same ``sf_dir`` read
    it (month filters then prune partitions)."""
    from .sinks import write_fact
    write_fact(fact_from_tables(spark, sf_dir), path, mode="overwrite")
    spark.conf.set(FACT_PATH_KEY, path)
    spark.conf.set(FACT_SOURCE_KEY, sf_dir.rstrip("/"))
    return path


def _registered_fact(spark: SparkSession, sf_dir: str) -> str | None:
    path = spark.conf.get(FACT_PATH_KEY, None)
    return path if path and spark.conf.get(FACT_SOURCE_KEY, None) == sf_dir.rstrip("/") else None


def fact_version(spark: SparkSession, sf_dir: str) -> str:
    """Changes whenever the files behind ``fact_table`` do."""
    from ..config import data_version, path_mark
    path = _registered_fact(spark, sf_dir)
    if path:
        return path_mark(spark, path) or data_version(spark.read.parquet(path))
    return data_version(*[read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "part")])


# The listing of a materialised fact, kept while its mark stays: application, path, kind -> (mark, DataFrame).
_listed: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def _kept(spark: SparkSession, path: str, kind: str, read) -> DataFrame:
    """``read()``, or what it returned before if no write has been committed since."""
    from ..config import path_mark
    key, mark = (spark.sparkContext.applicationId, path, kind), path_mark(spark, path)
    if mark is None:
        return read()
    if _listed.get(key, (None,))[0] != mark:
        _listed[key] = (mark, read())
    return _listed[key][1]


def fact_table(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The fact for ``sf_dir``: the materialised copy when one is registered
    for this source, otherwise derived lazily from the driver tables.  Month
    bounds (``YYYYMM``) limit what is read, by partition or by ship date.

    The month folders are listed anew only after a committed write, so rows
    appended since are seen."""
    path = _registered_fact(spark, sf_dir)
    if path:
        from .sinks import read_fact
        fact = _kept(spark, path, "rows", lambda: read_fact(spark, path))
        fact = fact if start is None else fact.where(F.col("ym") >= start)
        return fact if end is None else fact.where(F.col("ym") <= end)
    return fact_from_tables(spark, sf_dir, start, end)


def stored_months(spark: SparkSession, path: str, schema=FACT_SCHEMA) -> DataFrame:
    """``ym, rows`` of a month-partitioned table from its folders and parquet
    footers alone: the count per partition value is pushed into the scan, so no
    data page is read."""
    def read():
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        sources = spark.conf.get("spark.sql.sources.useV1SourceList")
        # Only the newer parquet source takes aggregates; which one a table is read by is settled when it is loaded.
        spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in sources.split(",") if x != "parquet"))
        try:
            return spark.read.schema(schema).parquet(path)
        finally:
            spark.conf.set("spark.sql.sources.useV1SourceList", sources)
    return _kept(spark, path, "months", read).groupBy("ym").agg(F.count("*").alias("rows"))


def fact_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of the fact (``ym, rows``), without reading rows where the fact is materialised."""
    from .sinks import has_other_months
    path = _registered_fact(spark, sf_dir)
    if path and not has_other_months(spark, path):
        return stored_months(spark, path)
    return fact_table(spark, sf_dir).groupBy("ym").agg(F.count("*").alias("rows"))
