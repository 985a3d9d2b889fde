import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wide river stone " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns named like results."""
    rows = [
        (1, "a lone line", "en", "s", 11), (1, "a lone line", "en", "s", 11), (2, None, "en", None, None), (3, "", None, "s", 0),
        (None, "no id at all", "en", "s", 12), (None, None, None, None, None), (4, LONG, "en", "s", len(LONG)),
        (5, LONG, "en", "s", len(LONG)), (6, "1234 !?", "de", "s", 7), (7, "ein Wort\nnoch ein Wort", "de", "s", 22), (7, "other text, same id", "de", "s", 19),
    ]
    names = {"fp": 1, "digest": "x", "line": 2, "score": "y", "leaks": 3, "ids": 4, "shard": 5, "slot": "z", "license": 6, "component_id": 7, "line_cuts": 8,
             "label": "q", "lang_pred": 1, "accepted": 2, "n_tokens": "n", "word": 3, "group": 4, "places": 1, "lines": "l", "class_id": 5}
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in names.items()})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
