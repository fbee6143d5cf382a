from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.session import local_session  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    """A session for each module: what earlier modules cached and broadcast, and the record of their jobs, is gone with theirs."""
    s = local_session(8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *sort):
    """Rows as dictionaries, ordered."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[c]) for c in sort)) if sort else out
