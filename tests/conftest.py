import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runlens.session import build_session, checkpoint_dir, scratch_path  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="runlens-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


def rows(df, *cols):
    """Sorted plain tuples of the given columns."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def scratch(spark, name):
    """A fresh folder under the shared checkpoint folder for one test."""
    return scratch_path(spark, f"tests-{uuid.uuid4().hex[:10]}/{name}")
