import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from basalt.session import session

    where = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{where}/shared", "spark.sql.warehouse.dir": f"{where}/warehouse", "spark.driver.memory": "3g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
