import pytest

#: What every operator must take: null and repeated ids, null, empty and long texts, ties, columns with clashing names.
LONG = " ".join(f"word{i % 977} more{i % 331}" for i in range(30_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again."), (1, "The quick brown fox jumps over the lazy dog again and again."), (2, None), (3, ""), (4, " \t\n "), (None, "No id here, but words enough to matter."),
    (None, None), (5, "one two"), (6, "ONE two"), (7, LONG), (8, LONG + " end"), (9, "naïve café — 日本語テキスト 😀 #*$%"), (9, "another text of the same id"), (10, "a" * 5000),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "x", None, k, "k1", "b", 7, "u", "i") for k, (i, t) in enumerate(ODD)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, part string, kind int, clean_text string, gone_id string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
