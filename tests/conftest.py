from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sensortwin.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8, app_name="sensortwin-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="sensortwin-test-ckpt-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="sensortwin-test-wh-")})
    s.sparkContext.setCheckpointDir(s.conf.get("spark.checkpoint.dir"))
    yield s
    s.stop()
