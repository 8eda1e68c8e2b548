import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("LODEVEC_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodevec.session import build_session, ship

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh"))})
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    return s


@pytest.fixture(scope="session")
def tiny():
    at = f"{DATA}/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no test data here")
    return at
