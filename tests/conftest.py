import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ticketlake.session import local_session

    return local_session(8, "ticketlake-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
