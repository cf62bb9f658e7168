import pytest

LONG = "word " * 60000 + "x" * 5000 + " ends here"
TEXTS = [
    (0, "The quick brown fox.\nThe quick brown fox.\nMail joe@example.com or call +1 (234) 567-8901 now.", "en", "a"),
    (1, "", "en", "a"),
    (2, None, None, None),
    (3, LONG, "en", "b"),
    (4, "Same text here, word for word.", "en", "a"),
    (5, "Same text here, word for word.", "en", "b"),
    (5, "Same text here, word for word.", "en", "b"),
    (None, "No number, but text: 字字 café \U0001f600", None, "c"),
    (7, " \n\t\x0b\x0c\r ", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, document string, size string, ids string, score string, fp string"


def rows(texts):
    return [(*t, None if t[1] is None else len(t[1]), "d", "s", "i", "c", "f") for t in texts]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and very long texts, repeated rows, and columns whose names clash with those that operators add."""
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows(TEXTS), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (4, 1, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "http://a/b", "<p>x</p>", "z"), (1, "http://a/b", "<p>x</p>", "z"), (None, None, None, "z"), (700, "u", "y" * 200000, "z")], "page_id long, url string, html string, offset string").write.parquet(f"{d}/pages.parquet")
    items = [(1, "same text: fox quick, QUICK mail"), (2, None), (3, "..."), (None, "text 😀 word"), (1, "ends here"), (4, "text")]
    spark.createDataFrame([(*x, 9, "t") for x in items], "item_id long, text string, score long, term string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d
