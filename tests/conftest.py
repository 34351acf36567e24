import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lawspark.session import local_session

    home = tmp_path_factory.mktemp("spark")
    from pyspark.sql import SparkSession

    SparkSession.builder.config("spark.sql.warehouse.dir", str(home / "warehouse")).config(
        "spark.checkpoint.dir", str(home / "scratch")
    )
    s = local_session(8, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
