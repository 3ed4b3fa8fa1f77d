import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest


@pytest.fixture(scope="session")
def spark():
    from docketry.session import session

    spark = session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
