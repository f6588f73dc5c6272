import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from bandwright.session import builder

    s = (
        builder("tests", "4", 4)
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Sorted plain rows of a DataFrame."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def data():
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not Path(d).exists():
        pytest.skip("no test tables")
    return d
