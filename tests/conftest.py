from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sparkloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, "tests", **{"spark.checkpoint.dir": f"file://{folder}", "spark.driver.memory": "6g", "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    yield session
    session.stop()
