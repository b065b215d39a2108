import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from spendlens.config import SCALE_CONF
    b = (SparkSession.builder.master("local[*]").appName("spendlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # Tests run without a cluster-provided checkpoint folder: set our own.
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spendlens-test-ckpt-"))
    from spendlens.config import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="spendlens-test-")


FACT_DDL = ("ym string, nation string, industry string, age_level string, "
            "trans_count bigint, trans_total bigint")


@pytest.fixture
def make_fact(spark):
    def make(rows):
        return spark.createDataFrame(rows, FACT_DDL)
    return make
