import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


#: Names that operators use inside, added to inputs to see that nothing clashes.
CLASHING = ["id", "cid", "digest", "rep", "copies", "key_", "gram", "at", "n", "block", "shard", "rank", "score", "bounds", "window", "salt", "hash", "value", "list", "g", "cell", "h1", "nth"]


@pytest.fixture(scope="session")
def cluttered():
    from pyspark.sql import functions as F

    def add(df):
        return df.select("*", *(F.lit(7).alias(c) for c in CLASHING if c not in df.columns))

    return add
