import os

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids int, score int, component_id int, cell int, fp0 int, which int, doc int, kept int"


def rows_of(texts):
    """Rows of documents with extra columns whose names the operators use inside."""
    return [(i, t, lang, "s", len(t or ""), 1, 2, 3, 4, 5, 6, 7, 8) for i, t, lang in texts]


LONG = "the quick brown fox jumps over the lazy dog and runs away from here " * 4000

EDGES = [
    (1, None, "en"), (2, "", "en"), (3, "  \n\t ", "en"), (4, LONG, "en"), (5, "same text of a few plain words here", "en"),
    (6, "same text of a few plain words here", "en"), (6, "same text of a few plain words here", "en"), (None, "a row without an id", None), (8, "12 34 !!", "fr"), (9, "x" * 30000, None),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(rows_of(EDGES), DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
