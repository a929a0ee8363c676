"""SimHash fingerprints, linked by BK-trees within shards.

Two fingerprints that differ in at most r bits agree on some of r + 2 blocks of bits: on at
least two of them. Each pair of blocks makes a shard key, so every link lies inside
a shard. A shard's distinct fingerprints form a BK-tree (children keyed by their Hamming
distance to the parent), searched with all of them along the edges within the radius. A
shard that is too large for one tree is split by the same rule on the bits that its key leaves
open, until it is small or nearly all bits are fixed, so no link is lost and no tree is unbounded.

For near copies of a given similarity the radius is too wide for that; `similar_texts` takes
longer fingerprints, shards by minimal shingle hashes instead, and compares the shingle sets of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import by_batch, join_groups, ready, whole_text, written
from platter.llm.components import components

BITS = 64
SEED = 42
# Distinct fingerprints of one tree. A larger shard is split again by bits that are still open.
TREE_SIZE = 4096
# With so few open bits a shard holds at most 2^OPEN_BITS fingerprints and is not split further.
OPEN_BITS = 14


def _shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of the space-joined shingles, repeats included; fewer words make one shingle, none make none."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.fromiter((digest(line[a:b], seed) for a, b in pairs), np.uint64, last)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """One word of a fingerprint: the bits set in over half the hashes; zero without any."""
    set_bits = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65536):
        some = hashes[start : start + 65536].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)


def simhash(text: str, shingle: int) -> int:
    """The fingerprint of a text; zero without words."""
    return int(_majority(_shingle_hashes(text, shingle, SEED))[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as long) of every row; a null text counts as empty and has fingerprint zero."""
    ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["_id", "fingerprint"])

    given = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = f"_id {given.schema['_id'].dataType.simpleString()}, fingerprint long"
    return given.mapInArrow(by_batch(run), schema).withColumnRenamed("_id", id_col)


def _away(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints ^ one).sum(axis=1, dtype=np.int64)


class BKTree:
    """Distinct fingerprints, (n, words) of 64 bits, in a tree whose edges carry the Hamming distance to the parent."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        # Of each node: its children as {distance: node}. Subtrees are split off their root all at once.
        self.children: list[dict[int, int]] = [{} for _ in prints]
        todo = [np.arange(len(prints))] if len(prints) else []
        while todo:
            members = todo.pop()
            root, rest = int(members[0]), members[1:]
            away = _away(prints[rest], prints[root])
            for distance in np.unique(away).tolist():
                own = rest[away == distance]
                self.children[root][distance] = int(own[0])
                todo.append(own)

    def within(self, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, the queries within the radius of it); all fingerprints are queries."""
        todo = [(0, np.arange(len(self.prints)))] if len(self.prints) else []
        while todo:
            node, queries = todo.pop()
            away = _away(self.prints[queries], self.prints[node])
            yield node, queries[away <= radius]
            for distance, child in self.children[node].items():
                onward = queries[np.abs(away - distance) <= radius]
                if len(onward):
                    todo.append((child, onward))


def forest(prints: np.ndarray, radius: int) -> np.ndarray:
    """Of each fingerprint of a shard the number of the first one of its component."""
    parent = np.arange(len(prints))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for node, near in BKTree(prints).within(radius):
        if len(near) > 1:
            roots = {root(i) for i in near.tolist()}
            least = min(roots | {root(node)})
            parent[list(roots)] = least
            parent[root(node)] = least
    return np.array([root(i) for i in range(len(prints))])


def _block(low: int, size: int) -> Column:
    return F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << size) - 1))


def _cut(positions: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """Bit ranges (low, size) divided into so many parts of about equal size."""
    bits = [b for low, size in positions for b in range(low, low + size)]
    out = []
    for k in range(parts):
        own = bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]
        ranges: list[tuple[int, int]] = []
        for b in own:
            if ranges and sum(ranges[-1]) == b:
                ranges[-1] = (ranges[-1][0], ranges[-1][1] + 1)
            else:
                ranges.append((b, 1))
        out.append(ranges)
    return out


def _shards(prints: DataFrame, radius: int) -> Iterator[tuple[DataFrame, list[str]]]:
    """Tables of shards (key columns, fingerprint) with bounded shards, which together hold every link."""
    blocks = _cut([(0, BITS)], radius + 2)
    keyed = []
    for number, pair in enumerate(combinations(range(radius + 2), 2)):
        fixed = [r for i in pair for r in blocks[i]]
        left = [r for i, block in enumerate(blocks) if i not in pair for r in block]
        keyed.append((number, fixed, left))
    table = prints.withColumn(
        "_shard", F.explode(F.array(*[F.struct(F.lit(n).alias("way"), F.array(*[_block(*r) for r in fixed]).alias("bits")) for n, fixed, _ in keyed]))
    ).withColumn("_way", F.col("_shard.way")).withColumn("_key", F.xxhash64("_shard")).drop("_shard")
    # Keys are hashes of the fixed bits: two shards that share one only make a larger tree.
    open_bits = {n: left for n, _, left in keyed}
    while True:
        sizes = written(table.groupBy("_way", "_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shard-sizes")
        splittable = [n for n, left in open_bits.items() if sum(size for _, size in left) > OPEN_BITS]
        large = (F.col("_n") > TREE_SIZE) & F.col("_way").isin(splittable)
        yield table.join(sizes.filter(~large).drop("_n"), ["_way", "_key"])
        if not splittable or sizes.filter(large).isEmpty():
            return
        hot = table.join(sizes.filter(large).drop("_n"), ["_way", "_key"])
        finer, branches, names = {}, [], iter(range(1 << 20))
        for n in splittable:
            parts = _cut(open_bits[n], radius + 1)
            made = []
            for i, part in enumerate(parts):
                name = next(names)
                finer[name] = [r for j, other in enumerate(parts) if j != i for r in other]
                made.append(F.struct(F.lit(name).alias("way"), F.xxhash64("_key", F.array(*[_block(*r) for r in part])).alias("key")))
            branches.append((n, F.array(*made)))
        choice = reduce(lambda c, b: c.when(F.col("_way") == b[0], b[1]), branches, F)
        table = hot.withColumn("_next", F.explode(choice)).select(
            "fingerprint", F.col("_next.way").alias("_way"), F.col("_next.key").alias("_key")
        )
        open_bits = finer


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between the distinct fingerprints that connect all within the radius of each other.

    A shard gives a spanning forest of its links, not all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                prints = np.sort(members.values.to_numpy())
                roots = forest(prints.view(np.uint64)[:, None], radius)
                member = np.flatnonzero(roots != np.arange(len(prints)))
                a.append(prints[member])
                b.append(prints[roots[member]])
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *x])) for x in (a, b)], ["a", "b"])

    found = [
        shards.groupBy("_way", "_key").agg(F.collect_set("fingerprint").alias("members")).select("members").mapInArrow(run, "a long, b long")
        for shards in _shards(prints, radius)
    ]
    return reduce(DataFrame.unionByName, found)


def near_copies(
    docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id (smallest id of its component).

    Texts without words have fingerprint zero and link like any other. Rows with equal
    fingerprints are linked. Null ids never name a component unless all its ids are null.
    Repeated ids give a row each. Other columns are ignored.
    """
    ready(docs.sparkSession)
    rows = written(
        fingerprints(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "_id"), "fingerprints"
    )
    groups = written(
        rows.groupBy("fingerprint").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")), "distinct-fingerprints"
    )
    roots = components(links(groups.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    rooted = groups.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"), F.sum("_n").alias("_size"))
    named = join_groups(
        rooted.select("fingerprint", "_n", "root"), least.select("root", "component_id", "_size"), "root", "_size", rows.count()
    ).select("fingerprint", "component_id", "_n")
    return join_groups(rows, named, "fingerprint", "_n", rows.count()).select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


# The second way to shard, for radii at which too many blocks differ: texts that share many
# shingles agree on a band of minimal shingle hashes.
BANDS, ROWS = 10, 3
WORDS = 4
# The radius only picks candidates, so it is wide.
DEVIATIONS = 5
# Of a node's candidates in a shard, nearest first, how many have been tried after each round.
TRIED = (1, 16, None)
# A set's shingles are counted in so many buckets; the counts bound what two sets have in common.
BUCKETS = 128
_rng = np.random.default_rng(20240102)
_MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def radius_for(similarity: float, words: int = WORDS) -> int:
    """Bits that texts of this Jaccard similarity differ in, with DEVIATIONS standard deviations on top."""
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine) / np.pi)
    bits = BITS * words
    return int(np.ceil(bits * share + DEVIATIONS * np.sqrt(bits * share * (1 - share))))


def _bands(hashes: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 4096):
        mixed = hashes[start : start + 4096, None] * _MULTIPLIERS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, mixed.min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(band.tobytes(), n) - (1 << 63) for n, band in enumerate(rows)]


def _pieces(members: DataFrame, total: int) -> DataFrame:
    """(shard, _one, _other, _piece, node, print): members (shard, node, print) of shards with several, for each pair of pieces.

    A shard is dealt into pieces of about TREE_SIZE nodes. A node stands in one piece and goes to all
    pairs that the piece is part of, so any two members of a shard meet in one pair at least.
    """
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sized = join_groups(members, sizes, "shard", "_n", total)
    dealt = sized.withColumn("_of", F.ceil(F.col("_n") / TREE_SIZE)).withColumn("_piece", F.pmod(F.xxhash64("node", "shard"), "_of"))
    paired = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
    one, other = F.least("_piece", "_with").alias("_one"), F.greatest("_piece", "_with").alias("_other")
    return written(paired.select("shard", one, other, "_piece", "node", "print"), "shard-members")


def _counts(grams: np.ndarray) -> bytes:
    """How many of the distinct hashes fall into each bucket, at most 255."""
    found = np.bincount((grams % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def _can_reach(similarity: float, sizes: np.ndarray, counts: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Whether set i and others can have this Jaccard similarity: never False for two sets that have it.

    What two counts of a bucket differ by is in one set only, and no more than that is left of it at most 255.
    """
    apart = (np.maximum(counts[others], counts[i]) - np.minimum(counts[others], counts[i])).sum(axis=1, dtype=np.int64)
    both = sizes[others] + sizes[i]
    common = (both - apart) // 2
    return common / np.maximum(both - common, 1) >= similarity


def _shingle_sets(texts: DataFrame, groups: DataFrame, pieces: DataFrame, shingle: int) -> DataFrame:
    """(node, grams, counts): the shingle hashes of the nodes that share a shard with others, and how many fall into each
    bucket; one text (_text) is read for each node."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = [np.unique(_shingle_hashes(text, shingle, SEED)) for text in batch.column(1).to_pylist()]
        columns = [
            batch.column(0), pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64())), pa.array([_counts(g) for g in grams], pa.binary())
        ]
        return pa.RecordBatch.from_arrays(columns, ["node", "grams", "counts"])

    wanted = groups.select("node", "_digest").join(pieces.select("node").distinct(), "node", "left_semi")
    # Copies are combined inside the tasks, so a text with many sends a row per task.
    one_each = texts.groupBy(F.unhex(F.md5("_text")).alias("_digest")).agg(F.min("_text").alias("_text"))
    return written(one_each.join(wanted, "_digest").select("node", "_text").mapInArrow(by_batch(run), "node long, grams array<long>, counts binary"), "shingle-sets")


def _candidates(prints: np.ndarray, piece: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(member, the others within the radius of it, their distances); with two pieces, others of the other piece."""
    both = len(np.unique(piece)) > 1
    for i in range(len(prints)):
        away = _away(prints, prints[i])
        near = (away <= radius) & ((piece != piece[i]) if both else True)
        near[i] = False
        others = np.flatnonzero(near)
        yield i, others, away[others]


def _proposals(radius: int, similarity: float, start: int, until: int | None):
    """A mapInArrow function from the members of pairs of pieces to pairs of nodes (a, b) to be verified.

    Of each member the candidates from number `start` to number `until`, nearest first, if they have
    other labels and can reach the similarity. A row without a pair says that such candidates are left for the next round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for key, members in zip(keys, batch.column(3)):
                fields = members.values
                nodes, piece, labels, sizes = (fields.field(name).to_numpy() for name in ("node", "_piece", "label", "size"))
                by_node = np.argsort(nodes)
                nodes, piece, labels, sizes = nodes[by_node], piece[by_node], labels[by_node], sizes[by_node]
                prints = np.frombuffer(b"".join(fields.field("print").to_pylist()), np.uint64).reshape(-1, WORDS)[by_node]
                counts = np.frombuffer(b"".join(fields.field("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS)[by_node]
                if key[1] != key[2] and len(np.unique(piece)) < 2:
                    continue
                a, b, left = [], [], False
                for i, others, away in _candidates(prints, piece, radius):
                    if not len(others):
                        continue
                    others = others[np.argsort(away, kind="stable")]
                    foreign = labels[others] != labels[i]
                    now = others[start:until][foreign[start:until]]
                    now = now[_can_reach(similarity, sizes, counts, i, now)]
                    if until is not None and not left:
                        left = bool(_can_reach(similarity, sizes, counts, i, others[until:][foreign[until:]]).any())
                    a.append(np.minimum(nodes[i], nodes[now]))
                    b.append(np.maximum(nodes[i], nodes[now]))
                empty = np.zeros(0, np.int64)
                pairs = np.unique(np.stack([np.concatenate([empty, *a]), np.concatenate([empty, *b])]), axis=1)
                n = pairs.shape[1] + left
                ends = [pa.array([*side.tolist(), *[None] * left], pa.int64()) for side in pairs]
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * n, pa.int64()) for k in key), *ends], ["shard", "_one", "_other", "a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    pairs = written(pairs, "distinct-pairs")
    total = pairs.count()
    for end in ("a", "b"):
        sizes = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_n"))
        own = sizes.join(sets.select(F.col("node").alias(end), F.col("grams").alias(f"_{end}")), end)
        pairs = join_groups(pairs, own, end, "_n", total).drop("_n")
    common = F.size(F.array_intersect("_a", "_b"))
    return pairs.filter(common / (F.size("_a") + F.size("_b") - common) >= similarity).select("a", "b")


def similar_texts(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: id, component_id; texts of this similarity and more are linked.

    Similarity is Jaccard's over the sets of shingles. Texts are nodes by their set. Shards are bands of
    minimal shingle hashes; SimHash fingerprints of 256 bits within a wide radius pick the candidate
    pairs of a shard, and every link is a pair whose sets were compared. Candidates are tried nearest
    first, in a few rounds; pairs that earlier rounds connected are left out, and so are pairs whose sets have
    too little in common by the counts of their shingles. A shard with more than
    TREE_SIZE nodes is dealt into pieces, and every two pieces are searched together. Equal sets are
    always linked. Null texts count as empty, and all texts without words are alike. Null ids never
    name a component unless all its ids are null.
    """
    ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, bands, nodes = [], [], []
        for text in batch.column(1).to_pylist():
            hashes = np.unique(_shingle_hashes(text, shingle, SEED))
            words = [_majority(hashes * m) for m in _MULTIPLIERS[:WORDS]]
            prints.append(np.concatenate(words).tobytes())
            bands.append(_bands(hashes))
            nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(nodes, pa.int64())],
            ["_id", "_digest", "print", "bands", "node"],
        )

    given = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).withColumn("_digest", F.unhex(F.md5("_text")))
    id_type = given.schema["_id"].dataType.simpleString()
    rows = written(
        given.mapInArrow(by_batch(run), f"_id {id_type}, _digest binary, print binary, bands array<long>, node long"),
        "wide-fingerprints",
    )
    groups = written(
        rows.groupBy("node").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"), F.min("print").alias("print"), F.min("bands").alias("bands"), F.min("_digest").alias("_digest")),
        "distinct-wide-fingerprints",
    )
    total = groups.count()
    pieces = _pieces(groups.select("node", "print", F.explode("bands").alias("shard")), total)
    sets = _shingle_sets(given.select("_text"), groups, pieces, shingle)
    found, roots, tried = None, None, 0
    for until in TRIED:
        labelled = pieces.withColumn("label", F.col("node")) if roots is None else (
            pieces.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        )
        proposed = written(
            labelled.join(sets.select("node", F.size("grams").cast("long").alias("size"), "counts"), "node")
            .groupBy("shard", "_one", "_other")
            .agg(F.collect_list(F.struct("node", "_piece", "label", "print", "size", "counts")).alias("members"))
            .mapInArrow(_proposals(radius_for(similarity), similarity, tried, until), "shard long, _one long, _other long, a long, b long"),
            "candidate-pairs",
        )
        edges = written(_verified(proposed.filter("a IS NOT NULL").select("a", "b").distinct(), sets, similarity), "verified-pairs")
        found = edges if found is None else found.unionByName(edges)
        roots = written(components(found), "roots")
        more = proposed.filter("a IS NULL").select("shard", "_one", "_other")
        if until is None or more.isEmpty():
            break
        pieces = written(pieces.join(more, ["shard", "_one", "_other"], "left_semi"), "shard-members")
        tried = until
    rooted = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"), F.sum("_n").alias("_size"))
    total = rows.count()
    named = join_groups(rooted.select("node", "_n", "root"), least, "root", "_size", total).select("node", "component_id", "_n")
    return join_groups(rows.select("_id", "node"), named, "node", "_n", total).select(F.col("_id").alias(id_col), "component_id")
