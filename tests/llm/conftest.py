import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, source, lang), with an extra column of a clashing name."""
    def make(rows):
        rows = [(*r, None, None)[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string, key string")
    return make


@pytest.fixture(scope="session")
def sf(spark):
    if not os.path.isdir(SF):
        pytest.skip("driver test data not present")
    return SF


@pytest.fixture(scope="session")
def given(spark, sf):
    """Rows of a given table as dictionaries."""
    def read(name):
        return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    return read
