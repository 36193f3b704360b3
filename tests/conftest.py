import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from chronoloom.session import build_session

    return build_session("tests", cpus=4, memory="4g")


@pytest.fixture(scope="session")
def sf():
    return SF
