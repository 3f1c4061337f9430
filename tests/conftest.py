import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (SparkSession.builder.master("local[4]").appName("gemstats-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.maxMetadataStringLength", "2000"))
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # the cluster names the shared folder; a test session sets its own only if unset
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gemstats-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="gemstats-test-")


def rows(df, *cols):
    """Collected rows as plain tuples, in the given column order."""
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
