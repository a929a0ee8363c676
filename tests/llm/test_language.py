import zlib
from collections import Counter, defaultdict

import pyarrow as pa

from platter.llm import language
from platter.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op10_language"](spark, SF_DIR)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edges(spark, edge_docs, no_docs):
    model = language.learn(edge_docs.filter("lang <> 'xx'"))
    told = language.identify(edge_docs, model)
    assert told.columns == [c for c in edge_docs.columns if c != "lang_pred" and c != "score"] + ["lang_pred", "score"]
    rows = told.collect()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("de", "en")
    assert {r.lang_pred for r in rows if r.doc_id == 1} == {"en"}
    nothing = language.learn(no_docs)
    assert {r.lang_pred for r in language.identify(edge_docs, nothing).collect()} == {"und"}
    assert language.identify(no_docs, model).count() == 0


def grams_of(text):
    """n-grams by definition: lower-case letters, with one edge before and after each text."""
    chars = ["_", *[c if c.isalpha() else "_" for c in text.lower()], "_"]
    for order in language.ORDERS:
        for i in range(len(chars) - order + 1):
            gram = chars[i : i + order]
            if "_" not in gram[1:-1]:
                yield "".join(gram)


def test_equals_sets_of_grams(spark):
    """Against brute force with a set of n-grams per language in place of filters."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in docs.collect() if r.text and r.lang]
    counts = defaultdict(Counter)
    for r in rows:
        counts[r.lang].update(grams_of(r.text))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    share = {lang: {g: s for g, s in c.items() if s >= language.MIN_SHARE} for lang, c in share.items()}
    top = Counter()
    for c in share.values():
        for g, s in c.items():
            top[g] = max(top[g], s)
    known = {lang: {g for g, s in c.items() if s >= language.MIN_RELATIVE * top[g]} for lang, c in share.items()}

    model = language.learn(docs)
    assert model.languages == sorted(known)
    assert (model.false_rate < 0.01).all()
    shares, letters = model.shares([r.text for r in rows])
    for r, got, has in zip(rows, shares, letters):
        grams = list(grams_of(r.text))
        assert has == any(c.isalpha() for c in r.text)
        for lang, value in zip(model.languages, got):
            exact = sum(g in known[lang] for g in grams) / max(len(grams), 1)
            # No n-gram of the language is missed; false positives are corrected by their expected rate only.
            assert abs(value - exact) <= 0.02 + 3 * (model.false_rate.max() / max(len(grams), 1)) ** 0.5, (r.doc_id, lang)


def test_neighbours_change_nothing(spark):
    model = language.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = ["the and with", "", "und nicht", "the and with", "x"]
    together, _ = model.shares(texts)
    for text, row in zip(texts, together):
        assert (model.shares([text])[0][0] == row).all()


def test_long_text_in_pieces(spark, monkeypatch):
    model = language.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = ["the and with from this that " * 30, "short", "\u0391\u03a3 \u0130stanbul STRASSE " * 20]
    whole, letters = model.shares(texts)
    counted = language_counts(texts)
    for at_once in (1, 2, 7, 100):
        monkeypatch.setattr(language, "AT_ONCE", at_once)
        pieces, same = model.shares(texts)
        assert (whole == pieces).all() and (letters == same).all()
        assert language_counts(texts) == counted


def language_counts(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(["xx"] * len(texts)), pa.array(texts)], ["lang", "text"])
    (out,) = language._count(iter([batch]))
    return dict(zip(out.column("gram").to_pylist(), out.column("n").to_pylist()))


def test_odd_languages_are_not_learned(spark):
    rows = [(i, "the quick brown fox " * 500, "en") for i in range(10)] + [(99, "abc", "typo")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en"]


def test_rare_languages_are_told(spark):
    """A language below LEAST_LANGUAGE is told where its exact share is larger; brute force over the table of its n-grams."""
    english = [(i, f"the quick brown fox jumps over lazy dogs {i % 7} " * 400, "en") for i in range(10)]
    odd = [(100, "zwixu qorvat plemni", "xx"), (101, "zwixu plemni dorgha", "yy"), (102, "the quick brown fox", "typo")]
    texts = [(200, "qorvat zwixu"), (201, "dorgha"), (202, "the fox"), (203, "the dogs dorgha dorgha"), (204, "1 2"), (205, None), (206, "qorvat zwixu")]
    docs = spark.createDataFrame(english + odd, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model.languages == ["en"]
    assert {r.lang for r in model.rare.select("lang").distinct().collect()} == {"xx", "yy", "typo"}
    asked = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    told = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(asked, model).collect()}
    assert len(told) == len(english + odd + texts)
    known = defaultdict(set)
    for r in model.rare.collect():
        known[r.lang].add(r.gram)
    for r in asked.collect():
        first, score = model.predict([r.text])
        grams, counts = language._text_grams(r.text or "")
        shares = {k: sum(int(n) for g, n in zip(grams.view("int64").tolist(), counts) if g in v) / max(counts.sum(), 1) for k, v in known.items()}
        best = min(shares, key=lambda k: (-shares[k], k))
        want = (best, shares[best]) if shares[best] > score[0] else (first[0], score[0])
        assert told[r.doc_id] == want, r.doc_id
    assert told[100][0] == told[200][0] == told[206][0] == "xx" and told[101][0] == told[201][0] == "yy"
    assert told[0][0] == told[102][0] == told[202][0] == "en" and told[204] == told[205] == ("und", 0.0)


def test_only_rare_languages(spark, monkeypatch):
    """No language reaches the least share: none is in the filter, all are told."""
    monkeypatch.setattr(language, "LEAST_LANGUAGE", 0.9)
    docs = spark.createDataFrame([(1, "abc abd abe", "a"), (2, "xyz xyw xyv uvw", "b")], "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model.languages == []
    asked = docs.union(spark.createDataFrame([(3, "qqq", None)], docs.schema))
    told = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(asked, model).collect()}
    assert told == {1: ("a", 1.0), 2: ("b", 1.0), 3: ("b", 0.0)}
