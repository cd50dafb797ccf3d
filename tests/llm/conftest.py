import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tid string, row int, key string, h int, fp string"
LONG = " ".join(f"word{i % 977} and more{i % 13}." for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names operators use inside."""
    texts = [
        (1, "One line that is shared by several\nshort\nan own line of document 1", "en", "b"),
        (2, "  ONE line that is shared by several \t\nshort\nan own line of document 2\n", "en", "a"),
        (3, None, None, None), (4, "", "de", "a"), (5, " \t\n ", "fr", None), (6, LONG, "en", "b"),
        (7, "Ünïcode — naïve café; ΣΤΟΙΧΕΙΑ 日本語のテキスト 😀 end", "fr", "a"),
        (8, "This work is licensed under the GNU General Public License, version 3. MIT license; cc-by. Apache License", "en", "c"),
        (9, "an own line of document 1", "en", "b"), (10, "x", None, "b"), (10, "x", None, "b"), (10, "y tie", "en", "b"),
        (None, "One line that is shared by several", "en", "b"), (None, None, None, "c"), (11, "12 34 -- 56", "en", "c"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), "id", "tid", 1, "key", 2, "fp") for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The given table at its smallest, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
