"""Small tables with every awkward row."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LONG = "word " * 30_000


def awkward(spark, extra=()):
    """Nulls in any column, empty and very long texts, repeated rows and ids, a column with a clashing name."""
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "one", "en", "s", 3, "x"), (4, LONG, "en", "s", 5, "x"), (4, LONG, "en", "s", 5, "x"),
        (None, "a null id here", "en", "s", 5, None), (5, "same id first text", "en", "s", 5, "x"), (5, "same id other text", "en", "s", 5, "x"), (6, " \n\t ", "fr", None, 4, "x"),
        *((d, t, "en", "s", len(t or ""), "x") for d, t in extra),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
