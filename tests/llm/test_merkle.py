"""Proofs against trees built by their definition, for every shape of blocks and groups."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from platter.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def proof(levels, place, fanout):
    out = []
    for nodes in levels[:-1]:
        first = place - place % fanout
        out.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + fanout])))
        place //= fanout
    return out


def brute(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r, digest("".join(map(value, r)))))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        levels[name] = tree([h for _, h in trees[name]], fanout)
    top = tree([levels[name][-1][0] for name in names], fanout) if names else []
    out = []
    for k, name in enumerate(names):
        for place, (r, leaf) in enumerate(trees[name]):
            path = proof(levels[name], place, fanout) + proof(top, k, fanout)
            cur = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                cur = digest("".join(map(value, (*r[:3], r[3] + 1, r[4]))))
            for left, right in path:
                cur = digest(left + cur + right)
            out.append((r[0], leaf, levels[name][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("block,group", [(4, 4), (2, 2)])
def test_every_shape(spark, rows, monkeypatch, block, group):
    """Trees of 1, 2, 5, 17, 64 and 131 leaves, so that last nodes cover any number of blocks."""
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", block)
    monkeypatch.setattr(merkle, "GROUP_BLOCKS", group)
    monkeypatch.setattr(merkle, "CHUNK_BLOCKS", 3)
    data = []
    for k, size in enumerate([1, 2, 5, 17, 64, 131]):
        data += [(1000 * k + i, f"s{i % 3}", [None, "de", "en", "é", "zz", ""][k], i, f"text {i} é") for i in range(size)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert rows(merkle.verify_documents(docs)) == brute(data)


@pytest.mark.parametrize("fanout", [3, 5])
def test_other_fanouts(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 10)
    monkeypatch.setattr(merkle, "GROUP_BLOCKS", 10)
    data = [(i, None, ["a", "b"][i % 5 == 0], 1, f"t{i}") for i in range(150)]
    docs = spark.createDataFrame(data, SCHEMA)
    leaves = docs.select("doc_id", "lang", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf"), F.lit(1).alias("_pos"), F.lit(2).alias("a.b"))
    got = merkle.prove(leaves, "lang", ["doc_id"], fanout=fanout).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof")))
    assert got.columns == ["doc_id", "lang", "_pos", "a.b", "leaf", "proof", "subroot", "root", "folded"]
    want = {r[0]: (r[1], r[2], r[3]) for r in brute(data, fanout)}
    found = got.collect()
    assert len(found) == 150 and all((r.leaf, r.subroot, r.root) == want[r.doc_id] and r.folded == r.root for r in found)


def test_edges(spark, rows, edge_docs, no_docs):
    data = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in edge_docs.collect()]
    assert rows(merkle.verify_documents(edge_docs)) == brute(data)
    assert merkle.verify_documents(no_docs).count() == 0


def test_large_numbers(spark, rows):
    data = [(i, None, "en", (1 << 63) - 1, "x") for i in range(30)]
    assert rows(merkle.verify_documents(spark.createDataFrame(data, SCHEMA))) == brute(data)
