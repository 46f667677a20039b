import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from topicloom.session import build_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
