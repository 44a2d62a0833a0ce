from __future__ import annotations

import os
from pathlib import Path

import pytest

from quillbar.session import build_session, ship_package

# the state runner of streaming queries starts its own Python and takes only the path
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", 4, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__driver__memory="4g")
    ship_package(s)
    yield s
    s.stop()
