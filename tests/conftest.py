from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from stockrisk.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    shared = str(tmp_path_factory.mktemp("shared"))
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.warehouse.dir": warehouse,
        "spark.checkpoint.dir": shared,
    }
    session = local_session(8, "tests", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
