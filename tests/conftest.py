import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from lodewright.session import build_session

    session = build_session(
        "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
