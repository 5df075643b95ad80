import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ebbtide.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def day():
    return lambda n, hours=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hours)
