"""The pipeline's choice among rows of one id, in either order, and beside a column of a clashing name."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, stays string"
ROWS = [(4, "a text of some words that is one", None, None, 1, "x"), (4, "b other text of some words that is two", None, None, 2, "y"), (5, None, None, None, 0, "z"), (None, "q", None, None, 1, "n")]


@pytest.mark.parametrize("turn", [1, -1])
def test_least_text_stays(spark, turn):
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(ROWS[::turn], COLUMNS).coalesce(1), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted((ROWS[0], ROWS[2], ROWS[3]), key=str)
