import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, copies, repeated rows, clashing column names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, None, "en", 1), (2, "", "en", 2), (3, "   \n\t ", None, 3), (4, long, "en", 4), (5, long, "en", 5), (6, "one two", "fr", 6), (7, "one two", "fr", 6), (7, "one two", "fr", 6),
        (None, "no id at all here", "en", 8), (9, "Ünïcode ▁ 日本 🤗 \u0000 text", "de", 9), (10, "the same words again and again and again and again", "en", 10),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").withColumns({c: __import__("pyspark.sql.functions").sql.functions.lit(1) for c in ("hits", "fp", "ids_", "predicted", "held_out", "group", "component_id", "key")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
