import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="module")
def docs(spark: SparkSession):
    """Nulls, empties, repeats, ties, a long text, and extra columns with clashing names."""
    base = [f"w{i % 97}x{i % 13}" for i in range(400)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(0, " ".join(base[:80])), (1, " ".join(base[:80])), (2, None), (3, ""), (4, "   \n\t "),
            (5, "alpha " + passage + " omega"), (6, "beta\n" + passage + "\ngamma delta"),
            (7, " ".join(base[:80]).replace("w5x5", "changed")), (None, "one two three four five six seven"),
            (8, "word " * 50), (9, " ".join(base * 20)), (10, "é日本 😀 \x0b tab\tend"), (10, "é日本 😀 \x0b tab\tend"),
            (11, "first line\nsecond line\n\nthird line"), (12, "first line\nsecond line\n\nother line")]
    return spark.createDataFrame([(i, t, "x", 1, 2, "n") for i, t in rows],
                                 "doc_id bigint, text string, score string, n_words int, ids int, node string")
