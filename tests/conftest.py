import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from eventfit.session import DEFAULT_CONF
    b = (SparkSession.builder.master("local[4]").appName("eventfit-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="eventfit-test-ckpt-")))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
