"""Small fixtures for the operators of tidemark.llm."""

import pytest


@pytest.fixture()
def docs(spark):
    """Makes a documents table; rows are (doc_id, text) or (doc_id, text, source)."""

    def make(*rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:  # names that operators might use inside
            for c in ("key", "w", "h", "size", "rank", "hash", "row", "t", "lines", "text_md5", "item_id", "class_id"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make
