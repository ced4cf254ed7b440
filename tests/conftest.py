from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flockwise.session import build_session

    place = tmp_path_factory.mktemp("spark")
    session = build_session("local[4]", "tests", 4, spark_sql_warehouse_dir=str(place / "warehouse"), spark_checkpoint_dir=str(place / "checkpoints"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
