import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bundlescan.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g"})
    yield s
    s.stop()


def text_df(spark, rows):
    """rows: list of (path, text) in one bundle 'b' -> bundle_id, path, suffix, text."""
    from pyspark.sql import functions as F

    from bundlescan.sources.files import suffix
    df = spark.createDataFrame([("b", p, t) for p, t in rows], "bundle_id string, path string, text string")
    return df.withColumn("suffix", suffix(F.col("path")))
