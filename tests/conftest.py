import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from tideline.session import session

    s = session(8, **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()
