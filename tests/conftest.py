import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from periodlens.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="periodlens-warehouse-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def built(spark):
    """A registered query's DataFrame, built once for all tests (some write staged tables)."""
    from periodlens.plans import QUERIES
    sf, made = os.environ.get("PERIODLENS_TEST_SF", "/root/testdata/sf0.001"), {}

    def get(name):
        if name not in made:
            made[name] = QUERIES[name](spark, sf)
        return made[name]

    return get


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="periodlens-test-")
