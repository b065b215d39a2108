"""Plan lint over every registered query: no cross / nested-loop joins and
no Python UDFs anywhere in the physical plans."""
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def test_no_cross_joins_or_python_udfs(spark):
    bad = {}
    for name, fn in E.queries().items():
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_chart_months_reach_the_scan(spark, capsys):
    """Over the derived fact the month bounds are a range of ship dates in the scan."""
    from spendlens.sources.tables import fact_from_tables, fact_table
    fact_table(spark, SF, "199601", "199912").explain("formatted")
    scan = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("PushedFilters") and "l_shipdate" in line)
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01" in scan and "LessThan(l_shipdate,2000-01-01" in scan
    whole = fact_from_tables(spark, SF)
    assert sorted(fact_from_tables(spark, SF, "199612", "199712").collect()) == sorted(
        whole.where("ym between '199612' and '199712'").collect())
