import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from platter.llm import packing, token_file, tokens
from platter.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("alphabet", ["ab .,\n", " \n\t\x0b\x1c\x85 　​ a.", "Éßñ日😀'1_-, "])
def test_encoder_equals_library(library, alphabet, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_UNITS", 50)
    random.seed(7)
    texts = ["", " ", "<|endoftext|>"] + ["".join(random.choices(alphabet, k=random.randint(1, 30))) for _ in range(1500)]
    got = tokens.UnitEncoder(PATH).encode_batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(library, t) for t in texts]


def test_known_words_are_not_cut_again(library, monkeypatch):
    cut, units = [], tokens._UNITS

    class Counted:
        def findall(self, text):
            cut.append(text)
            return units.findall(text)

    monkeypatch.setattr(tokens, "_UNITS", Counted())
    encoder = tokens.UnitEncoder(PATH)
    text = "Längere words, many. " * 50 + "end"
    first = encoder.encode_batch([text])
    cut.clear()
    assert encoder.encode_batch([text]) == first == [np.array(ids_of(library, text), "<u4").tobytes()]
    assert sum(map(len, cut)) < 20


def test_markers_as_the_unchanged_library(spark):
    plain = Tokenizer.from_file(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|> y<|endoftext|><|endoftext|>\n", "<|endoftext| > a", "plain words, no marker"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = scratch_path(spark, "ids")
    token_file.write_tokens(docs, path, PATH, end_id=0)
    assert {r.doc_id: r.tokens for r in token_file.read_tokens(spark, path).collect()} == {i: [*ids, 0] for i, ids in enumerate(want)}
    packed = packing.pack(docs, PATH, 1).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == {i: len(ids) + 1 for i, ids in enumerate(want)}


def test_file_round_trip(spark, library, edge_docs, edge_rows):
    path = scratch_path(spark, "ids")
    token_file.write_tokens(edge_docs, path, PATH, end_id=0)
    got = token_file.token_digests(token_file.read_tokens(spark, path)).collect()
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, start = [], 0
    for i, text, _ in order:
        ids = [*ids_of(library, text), 0]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    one = token_file.read_tokens(spark, path).filter("doc_id = 12").collect()
    assert [r.tokens for r in one] == [[*ids_of(library, "a\n\na\n\n\nb"), 0]]


def test_empty_table(spark, no_docs):
    path = scratch_path(spark, "ids")
    token_file.write_tokens(no_docs, path, PATH, end_id=0)
    assert token_file.token_digests(token_file.read_tokens(spark, path)).count() == 0
    assert packing.pack(no_docs, PATH, end_id=1).count() == 0


def check_packing(rows, docs, library, size):
    """docs: (key, text); rows: dicts with that key."""
    pieces = {}
    for r in rows:
        pieces.setdefault(r["_key"], []).append(r)
    for key, text in docs:
        ids, at = [*ids_of(library, text), 1], 0
        for r in sorted(pieces.pop(key), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


@pytest.mark.parametrize("size, windows, together", [(2048, 16, 64), (64, 2, 2)])
def test_packing(spark, library, monkeypatch, size, windows, together):
    monkeypatch.setattr(packing, "TASKS_TOGETHER", together)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(9)
    got = [r.asDict() | {"_key": r.doc_id} for r in packing.pack(docs, PATH, 1, size, windows).collect()]
    check_packing(got, [(r.doc_id, r.text) for r in docs.collect()], library, size)


def test_packing_edges(spark, library, edge_docs, edge_rows):
    got = packing.pack(edge_docs, PATH, 1).collect()
    want = sum(len(ids_of(library, t)) + 1 for _, t, _ in edge_rows)
    assert sum(r.length for r in got) == want
    assert {r.doc_id for r in got} == {i for i, _, _ in edge_rows}
