import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ringsight.session import BLOCK_ROWS_KEY, build_session, clear_stages  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{
            "spark__sql__shuffle__partitions": "4",
            "spark__ui__enabled": "false",
            "spark__ui__showConsoleProgress": "false",
            "spark__driver__memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    # Small blocks, so that even small tables have many block borders.
    session.conf.set(BLOCK_ROWS_KEY, "300")
    session.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield session
    clear_stages(session)
    session.stop()
