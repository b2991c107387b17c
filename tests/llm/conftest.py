import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, _row string, score string"


@pytest.fixture
def documents(spark):
    """Documents of (doc_id, text) or (doc_id, text, source), with columns of clashing names."""
    def build(rows):
        return spark.createDataFrame(
            [(r[0], r[1], None, r[2] if len(r) > 2 else "web", len(r[1] or ""), 7, "x", "y") for r in rows], SCHEMA)

    return build


@pytest.fixture
def odd():
    """Null and empty texts, blanks, a very long text, repeated rows and ids, a null id."""
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "word " * 30_000), (6, "a b c d e f g h"),
        (6, "a b c d e f g h"), (6, "another text with the same id as others"), (None, "a b c d e f g h"),
        (9, "Ünï cödé ǅ 中文 ٣ \u0085 \x1c x"), (2**62, "a b c d e f g h"),
    ]
