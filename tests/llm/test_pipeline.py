"""Stages on whole small tables: what each drops, and that all handle odd rows."""

import corpus_pipeline
from platter.llm.common import table, written

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, SF_DIR), name)
        assert after.columns == columns and after.dtypes == docs.dtypes
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        before = after
    good = docs.join(table(spark, SF_DIR, "labels").filter("quality = 1"), "doc_id", "left_semi").count()
    assert before.count() > 0.5 * good
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF_DIR)
    assert packed.select("doc_id").distinct().count() == before.count()


def test_edges(spark, edge_docs, no_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars", "_key", "kept")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).collect()
        assert stage(spark, no_docs.select(docs.columns), SF_DIR).count() == 0


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], ROWS)


def test_repeated_rows_keep_their_text(spark):
    """Equal rows are one document: no copy of another, and runs copied from elsewhere still go."""
    line = " ".join(f"w{i}" for i in range(60))
    run = "\n".join(" ".join(f"r{k}x{i}" for i in range(20)) for k in range(4))
    rows = [(None, line), (None, line), (1, run), (2, run + "\nown"), (2, run + "\nown")]
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.dedup_lines(spark, _docs(spark, rows), SF_DIR).collect())
    assert got == [(0, line), (0, line), (1, run), (2, "own"), (2, "own")]


def test_stages_drop_rows_not_ids(spark):
    texts = [" ".join(f"{name}{i}" for i in range(80)) for name in "abcd"]
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[0]), (None, texts[3]), (None, texts[3] + " more")]
    got = corpus_pipeline.drop_near_copies(spark, _docs(spark, rows), SF_DIR).collect()
    kept = sorted((r.doc_id or 0, r.text[0]) for r in got)
    assert kept == [(0, "b"), (0, "d"), (1, "a"), (5, "c")]
    scored = corpus_pipeline.keep_quality(spark, _docs(spark, [(None, ""), (None, texts[0]), (7, ""), (7, texts[1])]), SF_DIR).collect()
    assert sorted((r.doc_id or 0, r.text) for r in scored) == [(0, texts[0]), (7, texts[1])]


def test_language_stage(spark, edge_docs):
    docs = edge_docs.filter("coalesce(length(text), 0) < 1000")
    kept = corpus_pipeline.identify_language(spark, docs, SF_DIR)
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 4, 9} <= ids and not ids & {2, 3, 8, 13}
