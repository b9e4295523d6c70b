import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and columns that clash with names used inside."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [
        (1, "Same text here.", "en", "a", 1),
        (2, "same TEXT here.", "en", None, 1),
        (2, "same TEXT here.", "en", None, 1),
        (None, "same text here.", None, "b", None),
        (None, None, None, None, None),
        (3, None, "de", "a", 0),
        (4, "", "de", "a", 0),
        (5, word * 3000, "fr", "a", 0),
        (6, "ÀÉ straße 中文 🙂 \u0000 \x1c   x" + " " * 40, "fr", "a", 0),
        (7, "x" * 50000, "fr", "a", 0),
        (8, "\n\n \t\n", "es", "a", 0),
        (9, "don't  stop\n<|endoftext|> 'S 12345", "es", "a", 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    clash = "score ids decoded kept keep_id class_id key size length piece sequence_id offset run __rank line licence path __run __h64 __keep __size __kept __key __hash __score __marks __dir digest tree pos item part".split()
    return spark.createDataFrame(rows, schema).selectExpr("*", *[f"'mine' AS `{c}`" for c in clash])
