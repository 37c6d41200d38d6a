import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from strandlake.session import session

    made = session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="3g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-tests-"),
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
