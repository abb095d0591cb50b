import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path(os.environ.get("STRANDLINE_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from strandline.session import local_session

    session = local_session("tests", 4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_folder():
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test tables")
    return str(folder)
