from __future__ import annotations

import pytest

from tests.helpers import MemoryTables
from tradewind.session import build_session
from tradewind.sources.warehouse import Warehouse


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "store"))


@pytest.fixture
def memory(spark):
    return lambda **rows: MemoryTables(spark, **rows)
