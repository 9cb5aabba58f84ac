from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from backdate.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("checkpoints"))
    # Plans name files by their whole path, however long that is.
    session = local_session(4, 4, **{"spark.checkpoint.dir": shared, "spark.sql.maxMetadataStringLength": 10_000})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
