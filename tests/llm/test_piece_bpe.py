import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from platter.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceBpe(PATH)


@pytest.mark.parametrize("alphabet", ["abthe ", "=-* /0", "the quick\n\t brown", "日本é😀▁<s>0x "])
def test_equals_library(model, alphabet):
    random.seed(5)
    texts = ["", " ", "  a", "▁", "<s>", "</s><0x0A>", "x" * 3000, "ab" * 2000]
    texts += ["".join(random.choices(alphabet, k=random.randint(1, 60))) for _ in range(1500)]
    want = model.library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(g, "<u4").tolist() for g in model.encode_batch(texts)] == want


def test_edges(spark, rows, edge_docs, edge_rows, no_docs, model):
    want = []
    for i, text, _ in edge_rows:
        ids = model.library.encode(text or "", add_bos=True, add_eos=True)
        raw, decoded = np.array(ids, "<u4").tobytes(), model.library.decode(ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows(piece_bpe.digests(edge_docs, PATH)) == sorted(want, key=repr)
    assert piece_bpe.digests(no_docs, PATH).count() == 0


def test_ids_and_texts(spark, edge_docs, model):
    for r in piece_bpe.encode_decode(edge_docs.filter("doc_id IN (1, 9, 12)"), PATH).collect():
        assert r.decoded == model.library.decode(np.frombuffer(bytes(r.ids), "<u4").tolist()) and r.n_tokens == len(r.ids) // 4
