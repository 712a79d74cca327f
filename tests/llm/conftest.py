import pytest

#: Columns whose names operators use inside.
CLASHING = ["id", "h", "fp", "key", "size", "bucket", "start", "end", "n", "part", "words", "rank", "root", "host", "held", "score"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source) rows, with further columns of names that operators use inside."""

    def make(rows, partitions=3):
        full = [(*r, *(None,) * (4 - len(r)), *["x"] * len(CLASHING)) for r in rows]
        schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
