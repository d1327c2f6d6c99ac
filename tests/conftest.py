import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sward.session import build_session
    s = build_session("local[4]", app="sward-tests", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a list of tuples (test helper only)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
