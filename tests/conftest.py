from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quarrylight.session import build_session

    session = build_session("tests", cores=4, shuffle_partitions=4, **{"spark__checkpoint__dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark__driver__memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
