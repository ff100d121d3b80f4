"""Rows with every odd case: null and empty texts, a null id, repeated rows, a long text, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, ids double, n long, shard string, family int, base string"
LONG = "Lorem ipsum dolor sit amet, consectetur! " * 3000


def odd_documents(spark):
    texts = [
        (1, "The quick brown fox jumps over the lazy dog."),
        (2, "The quick brown fox jumps over the lazy dog."),
        (2, "The quick brown fox jumps over the lazy dog."),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (None, "A row without an id, it's 2 o'clock."),
        (6, LONG),
        (7, "x"),
        (8, "été à l’école — 漢字 😀 token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\""),
        (9, "a" * 6000),
    ]
    rows = [(i, t, None if i == 4 else "en", "s", None if t is None else len(t), "?", 1, 0.5, 9, "z", 3, "b") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
