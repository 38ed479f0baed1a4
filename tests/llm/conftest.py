import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table, with columns that clash with the operators' own, from (doc_id, text, lang, source) rows."""

    def make(rows):
        rows = [(*r, "en", "s")[:4] if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], DOCS)
        return df.selectExpr("*", "'x' AS score", "1 AS fp", "'y' AS dk", "2 AS copy", "'z' AS lh", "3 AS n_removed", "4 AS component_id")

    return make


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder of tables as the driver has them, from rows by name."""

    def make(**by_name):
        root = tmp_path_factory.mktemp("tables")
        for name, (rows, schema) in by_name.items():
            spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{root}/{name}.parquet")
        return str(root)

    return make
