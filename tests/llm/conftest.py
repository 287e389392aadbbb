import pytest

from awkward_rows import AWKWARD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with an extra column whose name the operators use inside."""
    from pyspark.sql import functions as F

    def run(rows, partitions=3):
        full = [(i, t, "en", f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)]
        docs = spark.createDataFrame(full, SCHEMA).repartition(partitions)
        extra = ("key", "row", "fp", "blob", "n", "words", "weight", "topic", "held_out", "kept", "found")
        return docs.withColumns({c: F.lit("x") for c in extra})

    return run


@pytest.fixture(scope="session")
def awkward(make):
    return make(AWKWARD)
