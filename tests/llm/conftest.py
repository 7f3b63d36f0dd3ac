import pytest

#: Extra columns with the names that operators use inside.
EXTRA = "id, fp, node, guess, words, q_words, digit, hash, doc, item, url2, packed, component, lang_pred, span"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with null ids and texts, empty, blank and very long texts, repeated rows and clashing columns."""
    long = " ".join(f"word{k % 977} the of and token = abcdef{k}" for k in range(20_000))
    texts = [
        (1, "The cat sat on the mat and looked at the moon all night long."), (2, None), (3, ""), (4, " \n\t "), (5, long),
        (6, "The cat sat on the mat and looked at the moon all night long."), (None, "no id here at all, none"), (7, "12345 !!! ???"),
        (8, "x"), (8, "x"), (9, "Der Hund und die Katze\x00 sind 日本語 müde 😀 it's"), (9, "another text under the same id"),
    ]
    names = [c.strip() for c in EXTRA.split(",")]
    rows = [(i, t, "en" if k % 2 else "de", "s", 1, *(["x"] * len(names))) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
