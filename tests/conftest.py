import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from postmill.session import local_session

    s = local_session(4, memory="4g", partitions=4, app="tests", checkpoint=str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


@pytest.fixture
def evaluate(spark):
    """Evaluate one Column builder over a list of argument tuples, in one job."""
    from pyspark.sql import functions as F

    def run(fn, rows, schema):
        names = [c.strip().split(" ")[0] for c in schema.split(", ")]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
        out = df.select("i", fn(*[F.col(n) for n in names]).alias("out")).orderBy("i").collect()
        return [r.out for r in out]

    return run
