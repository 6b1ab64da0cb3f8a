import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, sources=None, first=0):
        rows = [(first + k, t, "en", sources[k] if sources else "a", len(t) if t else 0) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, repeated, very long, and other scripts."""
    return [None, "", " \t\n", "word", "word", "ÀÉ straße ﬁ 日本語 <|endoftext|> x", "a b c d e f g " * 4000, "\x00\x1c\x85 ' \" token = abcdefgh"]
