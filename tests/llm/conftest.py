import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, block int, size string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, repeated rows, copies, and columns whose names operators use themselves."""
    words = [f"w{i % 97}{'é' if i % 7 == 0 else ''}" for i in range(30000)]
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today"), (2, "the quick brown fox jumps over the lazy dog near the river bank today"), (3, None), (4, ""), (5, "  \t\n "),
        (6, "short one"), (7, "Short one"), (8, " ".join(words)), (9, " ".join(words) + " end"), (10, "Released under the MIT License.\nCC BY-NC 4.0 and cc by nc"), (10, "Released under the MIT License.\nCC BY-NC 4.0 and cc by nc"),
        (11, "x" * 5000), (12, "日本語 テキスト です ☃"), (None, "no id at all here"), (13, "a b c d e"), (14, "a b c d e f"),
    ]
    rows = [(i, t, None if i in (3, 12) else "en", None if i == 5 else f"s{(i or 0) % 3}", len(t or ""), 1, "k", 2, "big") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
