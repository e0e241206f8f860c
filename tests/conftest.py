import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from photonloom.session import build_session

    s = build_session("local[8]", 4, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()
