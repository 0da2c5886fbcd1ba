import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from veritrail.session import build

    home = tmp_path_factory.mktemp("spark")
    s = build("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(home / "warehouse"), "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
