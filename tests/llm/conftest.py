import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.exists(SF):
        pytest.skip("test data not present")
    return SF


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with extra columns of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, key string, digest string, score string, label string, start string"
        return spark.createDataFrame([(i, t, "k", "d", "s", "l", "x") for i, t in rows], schema)

    return make
