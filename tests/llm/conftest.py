import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("llm-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) rows, with further columns whose names clash with added ones."""

    def make(rows, extra=False, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in ("n_words", "kept", "score", "n_tokens", "d", "t", "n_lines", "component_id", "lang_pred", "h")})
        return df

    return make
