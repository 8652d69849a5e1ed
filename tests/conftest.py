import os
import sys
from datetime import timedelta
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from base import BASE  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from ticklake.session import clean_scratch, local_session
    from ticklake.streaming.dedup import STATE_STORE

    session = local_session("4", "ticklake-tests", **STATE_STORE)
    yield session
    clean_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def make_ticks(spark):
    """Ticks from (ticker, price, volume, seconds after BASE, exchange), arriving in that order."""
    from ticklake.schemas import TICK

    def build(rows):
        data = [
            (i, t, x, Decimal(str(p)), Decimal(str(v)), BASE + timedelta(seconds=s))
            for i, (t, p, v, s, x) in enumerate(rows)
        ]
        return spark.createDataFrame(data, TICK)

    return build


@pytest.fixture
def folder(spark):
    from ticklake.session import scratch

    return lambda label="t": scratch(spark, label)
