from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from capshift.session import get_session  # noqa: E402

AS_OF = dt.datetime(2024, 1, 22)


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4, app="capshift-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="capshift-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="capshift-test-")
