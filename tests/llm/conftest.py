import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, extra=False):
        """rows: texts, or (id, text) pairs; extra adds columns whose names clash with the operators' own."""
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOC)
        if extra:
            df = df.selectExpr("*", "'x' AS id", "1 AS n", "2 AS score", "3 AS h", "'y' AS line", "4 AS node", "5 AS words", "6 AS w", "7 AS th", "8 AS n_hit", "9 AS component_id")
        return df

    return make


@pytest.fixture(scope="session")
def rows():
    return lambda df, key="doc_id": {r[key]: r for r in df.collect()}
