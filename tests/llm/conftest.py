import public_tokenizers
import pytest

DOCS = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame([(k, t) for k, t in rows], DOCS)


@pytest.fixture
def path():
    return public_tokenizers.path
