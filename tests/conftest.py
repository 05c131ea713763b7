import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)


@pytest.fixture(scope="session")
def spark():
    from compare import make_spark

    session = make_spark("8")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")  # tiny data: few tasks
    yield session
    session.stop()
