import os

import pytest
from pyspark.sql import types as T

LONG = "Lorem ipsum dolor " * 4000
CLASHING = ["kept", "target", "n_words", "spans", "h1", "mix_size", "source_size", "__key", "__th", "edited", "input_ids", "score"]


@pytest.fixture(autouse=True)
def clean_warehouse(spark):
    yield
    for table in spark.catalog.listTables():
        if table.name.startswith("line_run_"):
            spark.sql(f"drop table {table.name}")


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) tuples, with extra columns of clashing names."""
    def make(rows, clashing=False):
        fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
        schema = T.StructType([T.StructField(n, t) for n, t in fields])
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
        if clashing:
            for name in CLASHING:
                df = df.selectExpr("*", f"'own' as `{name}`")
        return df

    return make


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, "one two three four five six", "en", None),
        (4, "one two three four five six", "en", None), (5, "one two three four five six", None, "b"),
        (None, "text without an id", "de", "b"), (None, None, None, None), (6, " \t\n\x0b\x0c\r ", "de", "b"),
        (6, "Same id, other text.\nLast line", "de", "b"), (7, "É ß 😀 \U0001f468‍\U0001f469 ſK\n\nline", "fr", "c"),
    ]


SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")
