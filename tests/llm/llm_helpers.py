SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None, first=0):
    rows = [(first + i, t, "en", sources[i] if sources else "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text."""
    rows = [
        (1, "same text here and more of it", "en", "a", 1), (1, "same text here and more of it", "en", "a", 1), (2, "same text here and more of it", None, None, None), (3, None, "en", "a", None),
        (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4), (None, "no id at all in this row", "en", "a", 3), (6, "word " * 30_000, "en", "a", 1), (7, "ünïcode 日本語 text", "de", "c", 1), (8, "x" * 50_000, "en", "a", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)
