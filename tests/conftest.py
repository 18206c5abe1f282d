from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerlark.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    return build_session("local[4]", **{"spark__sql__shuffle__partitions": "4", "spark__checkpoint__dir": f"file://{folder}/shared", "spark__local__dir": f"{folder}/local", "spark__driver__memory": "4g", "spark__sql__warehouse__dir": f"{folder}/warehouse"})


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
