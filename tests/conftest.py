import pytest

from trovelight.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, spark__ui__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Values of a column expression over one input column ``x``."""

    def run(values, build, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        out = rows.select("i", build("x").alias("y")).orderBy("i").collect()
        return [r["y"] for r in out]

    return run
