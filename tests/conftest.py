import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewlens.plans.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__driver__memory="6g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def reviews(spark):
    """Two families, an empty-sentiment row, a null aspect, one aspect with mixed reviews."""
    rows = [
        ("P", "P ONE", "Price", "Cheap", "positive", "US"),
        ("P", "P ONE", "Price", "Cheap", "positive", "US"),
        ("P", "P ONE", "Price", "Dear", "negative", "UK"),
        ("P", "P ONE", "Design", "Slim", "neutral", "US"),
        ("P", "P ONE", None, "Slim", None, None),
        ("P", "P TWO", "Price", "Dear", "negative", "UK"),
        ("Q", "Q 100%_A", "Design", "Slim", "positive", "UK"),
        ("Q", "Q 100%_A", "Generic", "Slim", "negative", "US"),
    ]
    from reviewlens.functions.scoring import with_score
    return with_score(spark.createDataFrame(
        rows, "Product string, Product_Family string, Aspect string, Keywords string, Sentiment string, Geography string"))


@pytest.fixture
def rows_of():
    def collect(df, *columns):
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
    return collect
