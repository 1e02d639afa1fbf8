import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="ledgerline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from ledgerline.sources.fixtures import fixtures
    return fixtures(spark, SF_SMALL)


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
