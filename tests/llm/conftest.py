import pytest

from platter.llm.common import ready

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
# Names that the operators use themselves.
CLASHES = (
    "_id _key _text _row _n _digest _maybe _slot _dropped _gone _all part kind ids block payload shard node print bands score "
    "lang_pred n_lines n_deleted kept keep_id fingerprint start tokens unit place digest license_id root at rank"
).split()


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang): nulls in every column, empty, blank and long texts, repeated rows and ids, odd characters."""
    return [
        (1, "the cat sat on the mat and the dog ran", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, "the cat sat on the mat and the dog ran", None),
        (5, LONG, "en"),
        (6, LONG + " more", "en"),
        (7, LONG, "de"),
        (8, " \n\t ", "en"),
        (9, "ein Haus, das Ünser ist 😀 日本   x", "de"),
        (9, "ein Haus, das Ünser ist 😀 日本   x", "de"),
        (9, "another text with the same id", "en"),
        (None, "no id here", "en"),
        (None, None, None),
        (12, "a\n\na\n\n\nb", "en"),
        (13, "123 456", "xx"),
    ]


@pytest.fixture
def edge_docs(spark, edge_rows):
    ready(spark)
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(i, t, g, None, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t, g in edge_rows]
    assert len(rows[0]) == len(names)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)
