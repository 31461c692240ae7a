from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from priorwise.session import checkpoint_dir, get_spark

    s = get_spark("local[4]", shuffle_partitions=8, app_name="priorwise-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def entry_mod():
    import __spark_entry__

    return __spark_entry__
