import pytest


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those of results."""
    rows = [
        (900, None, None, None, 1), (901, "", "en", "", 1), (902, " \n\t", None, "s", 1), (903, "a b c", "en", None, 1), (903, "a b c", "en", None, 1),
        (904, "abc", "en", "s", 1), (905, "x" * 50_000, "en", "s", 1), (906, "word " * 8_000, "en", "s", 1), (None, "the cat sat on the mat", "en", "s", 1), (907, "éa b ﬁ 日本語 😀", "fr", "s", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long").selectExpr("*", "size AS kept", "size AS component_id", "size AS fingerprint", "size AS block")


@pytest.fixture(scope="session")
def both(docs, odd):
    c = ["doc_id", "text", "lang", "source"]
    return docs.select(*c).unionByName(odd.select(*c))


@pytest.fixture(scope="session")
def clashing(odd, docs):
    """Rows with columns named as those of results and of intermediate tables."""
    names = "skey size source_size target taken rid bucket hash block start words shard slot pass_no held_out lang_pred score item_id row hits key n_shared n_shingles containment node buckets label n".split()
    rows = odd.select("doc_id", "text", "lang", "source").unionByName(docs.select("doc_id", "text", "lang", "source").limit(30))
    return rows.selectExpr("*", *[f"7 AS {n}" for n in names])
