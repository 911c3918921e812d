import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    from keystrata.api import Engine

    return Engine(spark, str(tmp_path_factory.mktemp("root")))


@pytest.fixture(scope="module")
def ask(engine):
    """Requests against one tenant."""

    def call(mode, **r):
        return engine.request({"mode": mode, "dir": "t", **r})

    return call


@pytest.fixture(scope="module")
def make(ask):
    """An object with fields, indexes and records."""

    def build(name, fields, records, indexes=()):
        made = ask("create-object", object=name, fields=fields, indexes=list(indexes))
        assert made.get("status") == "created", made
        assert "error" not in ask("bulk-insert", object=name, records=records)

    return build
