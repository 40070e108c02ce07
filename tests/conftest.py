import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from strata.session import build

    spark = build("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"), spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="spark-"))
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
