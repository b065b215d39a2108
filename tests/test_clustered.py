"""Facts in files clustered by industry and age band."""
import pytest
from pyspark.sql import functions as F

from spendlens.config import shared_path
from spendlens.schema import FACT_COLUMNS, FACT_SCHEMA
from spendlens.sources import sinks


@pytest.fixture(scope="module")
def fact(spark):
    """Two months of 40 industries; one industry holds a third of the rows; copies, nulls and junk months."""
    k = F.col("id")
    rows = spark.range(24_000).select(
        F.when(k % 2 == 0, "202401").otherwise("202402").alias("ym"), F.lit("n").alias("nation"),
        F.when(k % 3 == 0, "hot").otherwise(F.format_string("i%02d", (k * 7919 % 40).cast("int"))).alias("industry"),
        F.format_string("a%d", (F.floor(k / 6) % 4).cast("int")).alias("age_level"),
        k.alias("trans_count"), (k * 10).alias("trans_total"))
    odd = spark.createDataFrame([("junk", "n", "i01", "a0", 1, 1), (None, "n", None, "a0", 1, 1), ("202401", "n", None, None, 1, 1),
                                 ("202401", "n", "i01", "a0", 1, 1), ("202401", "n", "i01", "a0", 1, 1)], FACT_SCHEMA)
    return rows.unionByName(odd)


def rows_of(df):
    return sorted(map(str, df.select(FACT_COLUMNS).collect()))


def scanned(df):
    """Rows that the scan handed on, after row groups and pages were skipped."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def both(spark, fact):
    plain, clustered = shared_path(spark, "t-plain"), shared_path(spark, "t-clustered")
    sinks.write_fact(fact.repartition(8), plain)
    sinks.write_clustered_fact(fact, clustered, 40)
    return plain, clustered


def test_same_rows(spark, fact, both):
    want = rows_of(fact)
    assert rows_of(sinks.read_fact(spark, both[0])) == want and rows_of(sinks.read_fact(spark, both[1])) == want


def test_one_industry_skips_the_other_files(spark, both):
    one = [spark.read.parquet(p).where("ym = '202401' and industry = 'i10'") for p in both]
    plain, clustered = [df.select("trans_total") for df in one]
    assert sorted(plain.collect()) == sorted(clustered.collect()) and plain.count() > 100
    assert scanned(clustered) * 4 < scanned(plain)
    # Rows of one industry and month lie in few files.
    files = spark.read.parquet(both[1]).groupBy("ym", "industry").agg(F.count_distinct("_metadata.file_path").alias("n"))
    most = {(r["ym"], r["industry"]): r["n"] for r in files.collect()}
    assert max(n for (_, i), n in most.items() if i != "hot") <= 2


def test_hot_cell_is_split(spark, fact):
    path = shared_path(spark, "t-hot")
    sinks.write_clustered_fact(fact.where("industry = 'hot' and ym = '202401' and age_level = 'a1'"), path, 4)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)


def test_cluster_fact_after_appends(spark, fact):
    path, out = shared_path(spark, "t-appended"), shared_path(spark, "t-out")
    for month in ("ym = '202401'", "ym = '202402'"):
        sinks.append_new_rows(spark, fact.where(month), path)
    sinks.cluster_fact(spark, path, out, file_bytes=20_000)
    assert rows_of(sinks.read_fact(spark, out)) == rows_of(sinks.read_fact(spark, path))
    # What is clustered still takes appends, and only new rows.
    assert sinks.append_new_rows(spark, fact, out) == 2 and sinks.append_new_rows(spark, fact, out) == 0


def test_empty_fact(spark, make_fact):
    path = shared_path(spark, "t-empty")
    sinks.write_clustered_fact(make_fact([]), path, 3)
    assert sinks.read_fact(spark, path).count() == 0


def test_runs_are_bounded_by_rows_in_memory(spark, fact, monkeypatch):
    """Rows that repeat take few bytes stored and many in a sort: the latter bound a task's rows."""
    path, out = shared_path(spark, "t-repeats"), shared_path(spark, "t-bounded")
    sinks.write_fact(fact, path)
    monkeypatch.setattr(sinks, "SORTED_RUN_BYTES", 24_000 * sinks._ROW_BYTES // 8)
    sinks.cluster_fact(spark, path, out)
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy(F.spark_partition_id(), "_metadata.file_path").count().collect()]
    assert len(sizes) >= 8 and rows_of(sinks.read_fact(spark, out)) == rows_of(sinks.read_fact(spark, path))
