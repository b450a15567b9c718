import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

import __spark_entry__  # noqa: E402, F401  (makes the package ship with the jobs)


@pytest.fixture(scope="session")
def spark():
    from airgrid.core import session

    s = session("tests", cpus=8, spark__sql__shuffle__partitions="3")
    yield s
    s.stop()
