import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The shared folder of the session, which tests name themselves."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like internal ones."""
    long = " ".join(f"w{i} thing" for i in range(40_000))
    rows = [
        (1, "a plain text of some words, as they stand.", "en"), (1, "a plain text of some words, as they stand.", "en"),
        (2, "", "en"), (3, None, None), (None, "no id but some words here", "en"), (None, None, None), (4, " \n\t ", "fr"),
        (5, long, "en"), (6, long + " end", "en"), (7, "ÄÖ é 漢字 \U0001f600 ok", "de"), (7, "another text with a repeated id", "de"),
    ]
    names = "id data text_id n bands root code slot spans items ids part score words window host token key bucket a b u v".split()
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)
