import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents by (id, text) or (id, text, source)."""

    def made(rows, extra=()):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, DOC)
        for name in extra:  # columns that clash with names the operators use
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return made
