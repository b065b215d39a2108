"""Driver contract: entry, queries and oracle SQL agree on sf0.001."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["pos", "x", "y", "share", "growth"]
    assert df.count() > 0


def test_every_query_has_a_callable_and_sql_keys_subset():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if not hasattr(v, "isoformat") else v.isoformat()


@pytest.mark.parametrize("name", ["agg_bar_industry", "agg_pie_ym_tail", "agg_heatmap_coords",
                                  "dash_month_rank", "clean_pipeline", "req_hits", "agg_heatmap_pivot",
                                  "req_broken_rules", "req_results_points", "chart_titles",
                                  "src_csv_mixed_headers", "src_json_auto_wrapped", "etl_append_then_chart"])
def test_query_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    idx = [rel.columns.index(c) for c in cols]
    b = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert a == b


def test_fact_same_with_and_without_broadcast(spark):
    from pyspark.sql import functions as F
    from spendlens.sources.tables import BROADCAST_MAX_ROWS_KEY, fact_from_tables

    def digest(df):
        return df.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("trans_total").alias("t"),
                                F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()

    with_bc = digest(fact_from_tables(spark, SF))
    spark.conf.set(BROADCAST_MAX_ROWS_KEY, "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = fact_from_tables(spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert digest(df) == with_bc
    finally:
        spark.conf.unset(BROADCAST_MAX_ROWS_KEY)
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024)),
                     ("spark.sql.adaptive.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))):
            spark.conf.set(k, v)
