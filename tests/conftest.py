from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from compare import session

    s = session()
    root = str(Path(__file__).resolve().parents[1])
    s.sparkContext.environment["PYTHONPATH"] = root
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
    return s
