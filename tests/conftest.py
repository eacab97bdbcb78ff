import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from runlens.session import build_session

    session = build_session("tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from compare import connect

    return connect(SMALL)


@pytest.fixture
def hot(spark):
    """Every key with more than a dozen rows counts as hot."""
    spark.conf.set("runlens.hotKeyRows", "12")
    yield spark
    spark.conf.unset("runlens.hotKeyRows")
