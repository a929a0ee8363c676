import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from platter.llm import simhash
from platter.llm.components import components


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """Smallest index that each print reaches."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, p in enumerate(prints):
            near = np.flatnonzero(np.bitwise_count(prints ^ p) <= radius)
            least = min(label[j] for j in near)
            for j in [i, *near]:
                if label[j] > least:
                    label[j], changed = least, True
    return label


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_tree_finds_all_within_radius(radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(8))]))
    found = {(n, q) for n, near in simhash.BKTree(prints[:, None]).within(radius) for q in near.tolist()}
    want = {(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius).tolist()}
    assert found == want


@pytest.mark.parametrize("tree_size, open_bits", [(4096, 14), (3, 14), (3, 30)])
def test_links_lose_nothing(spark, monkeypatch, tree_size, open_bits):
    """Chains and clusters of fingerprints, with shards that must be split once and twice."""
    monkeypatch.setattr(simhash, "TREE_SIZE", tree_size)
    monkeypatch.setattr(simhash, "OPEN_BITS", open_bits)
    rng = np.random.default_rng(2)
    prints = [0, *rng.integers(0, 1 << 63, 30, dtype=np.uint64).tolist()]
    for _ in range(250):
        bits = rng.choice(64, rng.integers(1, 4), replace=False).tolist()
        prints.append(int(prints[rng.integers(0, len(prints))]) ^ sum(1 << b for b in bits))
    prints = np.unique(np.array(prints, np.uint64))
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    roots = {r.node: r.root for r in components(simhash.links(frame, 2)).collect()}
    got = [roots.get(p, p) for p in prints.view(np.int64).tolist()]
    want = brute_components(prints, 2)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(simhash.near_copies(docs).collect())
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    prints = np.array([brute_print(t) for t in texts], np.uint64)
    assert [int(r.fingerprint, 16) for r in got] == prints.tolist()
    assert [r.component_id for r in got] == brute_components(prints, 2)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = simhash.near_copies(edge_docs).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{brute_print(t):016x}") for i, t, _ in edge_rows)
    component = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert component[2, "0" * 16] == component[8, "0" * 16] == component[None, "0" * 16] == 2
    assert component[4, f"{brute_print(edge_rows[0][1]):016x}"] == 1
    assert simhash.near_copies(no_docs).count() == simhash.similar_texts(no_docs).count() == 0


@pytest.mark.parametrize("tree_size", [4096, 4])
def test_similar_texts(spark, monkeypatch, tree_size):
    monkeypatch.setattr(simhash, "TREE_SIZE", tree_size)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for group in range(8):
        base = rng.choice(words, 300).tolist()
        for _ in range(6):
            own = list(base)
            own[rng.integers(0, 300)] = "changed"
            rows.append((len(rows), " ".join(own), group))
    rows += [(100 + i, " ".join(rng.choice(words, 200)), 100 + i) for i in range(30)]
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string, grp long").drop("grp")).collect()
    component = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows)
    for i, _, group in rows:
        assert component[i] == (6 * group if group < 8 else i)


def test_large_shard_loses_no_pair(spark, monkeypatch):
    """Pairs of near copies in one shard that takes many pieces: every pair is found, whichever pieces its two are dealt into."""
    monkeypatch.setattr(simhash, "TREE_SIZE", 8)
    monkeypatch.setattr(simhash, "_bands", lambda hashes: [7])
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(30):
        base = rng.choice(words, 200).tolist()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:-1], "changed"]))]
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("tree_size", [4096, 40])
def test_links_are_exact(spark, monkeypatch, tree_size):
    """Pairs around the similarity: all at 0.8 and more are linked, none below."""
    monkeypatch.setattr(simhash, "TREE_SIZE", tree_size)
    monkeypatch.setattr(simhash, "_bands", lambda hashes: [7])
    rows, want = [], {}
    for pair in range(60):
        length = 20 + 5 * pair
        changed = max(round(length * (0.05 + 0.004 * pair)), 1)
        words = [f"p{pair}w{i}" for i in range(length + 4)]
        texts = [words, [*words[: length + 4 - changed], *(f"q{pair}w{i}" for i in range(changed))]]
        first, second = ({tuple(t[i : i + 5]) for i in range(length)} for t in texts)
        rows += [(2 * pair + n, " ".join(t)) for n, t in enumerate(texts)]
        linked = len(first & second) / len(first | second) >= 0.8
        want |= {2 * pair: 2 * pair, 2 * pair + 1: 2 * pair + (not linked)}
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert 10 < sum(i != c for i, c in want.items()) < 50


def test_only_pairs_that_can_be_alike_are_verified(spark, monkeypatch):
    """One shard of texts that share half their words, all of them within the radius, and one pair of near copies."""
    monkeypatch.setattr(simhash, "_bands", lambda hashes: [7])
    monkeypatch.setattr(simhash, "radius_for", lambda similarity: 256)
    compared, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: (compared.append(pairs.count()), verified(pairs, *rest))[1])
    same = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join([*same, *(f"r{i}w{k}" for k in range(60))])) for i in range(80)]
    rows.append((80, rows[3][1] + " more"))
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 3 if i == 80 else i for i in range(81)}
    assert sum(compared) < 100  # of 3,240 pairs


def test_bound_loses_no_pair():
    """Sets at and around the similarity, small and with more than 255 shingles in a bucket."""
    rng = np.random.default_rng(9)
    for size in (1, 3, 40, 400, 60000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets = [base] + [np.r_[base[: size - new], rng.integers(0, 1 << 63, new, dtype=np.uint64)] for new in sorted({0, size // 10, size // 9, size // 8, size // 5, size})]
        sizes = np.array([len(np.unique(s)) for s in sets])
        counts = np.frombuffer(b"".join(simhash._counts(np.unique(s)) for s in sets), np.uint8).reshape(-1, simhash.BUCKETS)
        everyone = np.arange(len(sets))
        for i in everyone:
            common = np.array([len(np.intersect1d(sets[i], s)) for s in sets])
            alike = common / (sizes + sizes[i] - common) >= 0.8
            assert not (alike & ~simhash._can_reach(0.8, sizes, counts, i, everyone)).any()


def test_similar_texts_edges(spark, edge_docs, edge_rows):
    got = simhash.similar_texts(edge_docs).collect()
    assert len(got) == len(edge_rows)
    component = {r.doc_id: r.component_id for r in got if r.doc_id not in (None, 9)}
    assert component[1] == component[4] == 1 and component[2] == component[3] == component[8] == 2
    assert component[5] == component[6] == component[7] == 5 and component[12] == 12


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (503, 501), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").withColumn("x", F.lit(1))).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 503: 500}
