import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cohortcart.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", shuffle_partitions=8, app_name="cohortcart-tests",
                            extra={"spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


@pytest.fixture()
def tmp_location(spark):
    from cohortcart.session import scratch_path
    return scratch_path(spark, "test")
