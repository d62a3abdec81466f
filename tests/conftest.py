import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from joulemill.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("shared")
    session = local_session(8, **{"spark.checkpoint.dir": str(root), "spark.sql.maxMetadataStringLength": "10000", "spark.sql.warehouse.dir": str(root / "warehouse")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
