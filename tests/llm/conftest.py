import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, size string, fp string, bucket string"


def rows_of(texts, lang="en", source="a"):
    return [(k, t, lang, source, len(t or ""), 1, "s", "f", "b") for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table, with extra columns whose names clash with those of the operators."""
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "x", "a b c", "dup line\ndup line\n\n", "the same text of some words here", "the same text of some words here",
       "Ünï cödé wörds \U0001f600 here and there", "w " * 3000, "ab cd ef " * 200, "%%% ### " * 40, "\x1c\x85\xa0 odd spaces   end", "<|turn|>x</s>[INST]"]


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and long texts, repeated rows and ties."""
    rows = rows_of(ODD)
    rows += [rows[6], (None, "no id at all", None, None, None, None, None, None, None), (99, "other words in another language", None, "b", 5, 1, "", "", "")]
    return make(rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
