import random
import textwrap

import pytest

import corpus_pipeline
from platter.llm import licenses, line_dedup


def brute_maximal(rows, min_words):
    """Cleaned texts by extending every match with an earlier place as far as it goes."""
    lines = {i: (t or "").split("\n") for i, t in rows}
    places = [(i, [k for k, line in enumerate(lines[i]) if line.split()]) for i in sorted(lines)]
    starts = [(i, own, s) for i, own in places for s in range(len(own))]
    gone = {i: set() for i in lines}
    for n, (i, own, s) in enumerate(starts):
        for j, other, p in starts[:n]:
            length = words = 0
            while s + length < len(own) and p + length < len(other) and lines[i][own[s + length]] == lines[j][other[p + length]]:
                words += len(lines[i][own[s + length]].split())
                length += 1
            if words >= min_words:
                gone[i] |= set(own[s : s + length])
    return {i: ("\n".join(line for k, line in enumerate(lines[i]) if k not in gone[i]), len(gone[i])) for i in lines}


@pytest.mark.parametrize("min_words", [1, 5, 12])
def test_random_runs(spark, min_words):
    random.seed(min_words)
    pool = ["a b c", "d", "e f", "", "  ", "g h i j", "k l"]
    rows = [(i, "\n".join(random.choices(pool, k=random.randint(0, 25)))) for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words).collect()
    want = brute_maximal(rows, min_words)
    assert {r.doc_id: (r.text, r.n_deleted) for r in got} == want
    assert sum(n for _, n in want.values()) > 0


@pytest.mark.parametrize("sizes", [(60, 3, 3), (48, 5, 40)])
def test_pipeline_deletes_runs_to_their_end(spark, sizes):
    text = "\n".join(" ".join(f"l{n}w{i}" for i in range(size)) for n, size in enumerate(sizes))
    docs = spark.createDataFrame([(1, text, len(text)), (2, text, len(text))], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1: text, 2: ""}


def test_repeated_line_keeps_its_first_copies(spark):
    text = "x y\n" * 400 + "end"
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.text == "x y\nend" and got.n_deleted == 399


def test_edges(spark, edge_docs, no_docs):
    got = line_dedup.dedup_lines(edge_docs)
    assert got.columns == [c for c in edge_docs.columns if c not in ("n_lines", "n_deleted")] + ["n_lines", "n_deleted"]
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    assert all(r.text is None and r.n_lines == 0 for r in rows if r.doc_id == 2)
    texts = {r.doc_id: r.text for r in rows}
    assert texts[5] and texts[7] == "" and texts[6] and texts[1] == texts[4]
    assert texts[12] == "a\n\na\n\n\nb" and {r._key for r in rows} == {"x"}
    assert line_dedup.dedup_lines(no_docs).count() == 0


VARIANTS = [
    "released under the MIT license",
    "Released  under\tthe MIT Licence!!",
    "Copyright (c) 2020 Some One\nReleased under the MIT License.",
    "(c) 1999 X\n© 2001 Y\nreleased under the mit licence",
]


@pytest.mark.parametrize("text", VARIANTS)
def test_canonical_texts_match(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = licenses.scan(docs, licenses.known_digests(spark)).filter("unit = 'text'").collect()
    assert [(r.doc_id, r.place, r.license_id) for r in got] == [(1, 0, "MIT")]


def test_full_licence_with_british_spelling(spark):
    text = dict(licenses.KNOWN[:1])["MIT"].replace("MIT License", "MIT Licence").replace("sublicense", "sub-license").upper()
    docs = spark.createDataFrame([(1, text), (2, text + " and more"), (3, "Foo\n\nReleased under the MIT License.\nbar")], "doc_id long, text string")
    got = licenses.scan(docs, licenses.known_digests(spark)).collect()
    assert sorted((r.doc_id, r.unit, r.place, r.license_id) for r in got) == [(1, "text", 0, "MIT"), (3, "line", 2, "MIT")]


def test_scan_edges(spark, edge_docs, no_docs):
    known = licenses.known_digests(spark)
    assert licenses.scan(edge_docs, known).count() == 0
    assert licenses.scan(no_docs, known).columns == ["doc_id", "unit", "place", "license_id", "digest"]
    assert known.groupBy("digest").count().filter("count > 1").isEmpty()


FULL = [(i, t) for i, t in licenses.KNOWN if "\n\n" in t and not licenses.titled(t)]


def wrapped(text, width):
    """Each paragraph in lines of about `width` characters."""
    return "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in text.split("\n\n"))


def test_full_texts_inside_longer_documents(spark):
    """At the head, in the middle (below a title and a copyright paragraph) and at the end, wrapped anew and in capitals."""
    rows, want = [], set()
    for i, text in FULL:
        other = "Some words about a project.\n\nThis is more of them."
        head, body = wrapped(text, 60), wrapped(text, 75).upper()
        first = 1 if text.startswith("Copyright") else 0  # place of the first paragraph with words of its own
        for parts, place in (((head, other), 0), ((other, "Copyright (c) 2001 A", body, other), 3), ((other, head), 2)):
            rows.append((len(rows), "\n\n".join(parts)))
            want.add((len(rows) - 1, place + first, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.place, r.license_id) for r in licenses.scan(docs, licenses.known_digests(spark)).filter("unit = 'passage'").collect()}
    assert {i for i, _ in FULL} == {"MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "0BSD", "Unlicense"}
    assert got == want


def test_altered_text_is_no_licence(spark):
    rows = [(n, "Intro words.\n\n" + t.replace("software", "hardware").replace("SOFTWARE", "HARDWARE").replace("License", "Paper")) for n, (_, t) in enumerate(FULL)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert licenses.scan(docs, licenses.known_digests(spark)).isEmpty()
