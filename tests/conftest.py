import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from starwright.session import get_session

    scratch = tempfile.mkdtemp(prefix="starwright-tests-")
    s = get_session("local[4]", app_name="starwright-tests", shuffle_partitions=4,
                    conf={"spark.checkpoint.dir": f"{scratch}/checkpoints", "spark.sql.warehouse.dir": f"{scratch}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="starwright-test-")
