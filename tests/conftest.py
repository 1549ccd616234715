from __future__ import annotations

import importlib.util
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

if importlib.util.find_spec("h5py") is None:  # a stand-in with the few calls that cell files need, over npz archives
    STUB = os.path.join(os.path.dirname(os.path.abspath(__file__)), "stub")
    os.environ["PYTHONPATH"] = os.pathsep.join([STUB, os.environ.get("PYTHONPATH", "")])
    sys.path.append(STUB)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from annolith.session import build_session

    session = build_session("local[4]", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
