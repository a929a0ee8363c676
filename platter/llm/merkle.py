"""Merkle proofs for every row of a dataset, by butterfly exchange.

Rows are leaves; leaves of one tree stand in a given order and are cut into aligned blocks. Every
block hashes its own subtree. Then groups of blocks swap their subtree roots, round by round: in
round r the blocks that differ only in digit r of their number meet, and each of them hashes the
common ancestors itself. After the last round every block holds its whole upper proof and its root,
so nothing has to travel down a tree again. The roots of all trees are the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.llm.common import by_batch, ready, written

FANOUT = 2
# Leaves of a block and blocks of a swap, at most; the largest powers of the fanout within count.
BLOCK_LEAVES = 1024
GROUP_BLOCKS = 16
# Blocks of one tree that look up their tree's place among the trees together.
CHUNK_BLOCKS = 4096

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_LEVELS = "array<struct<left: string, right: string>>"
_LEVELS_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _power(fanout: int, most: int) -> int:
    """The exponent of the largest power of the fanout that is no larger than `most`; 1 at least."""
    exponent = 1
    while fanout ** (exponent + 1) <= most:
        exponent += 1
    return exponent


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _climb(nodes: list[str], count: int, fanout: int, most: int) -> tuple[str, list[list[str]]]:
    """The ancestor of an aligned run of nodes after at most `most` levels, and the nodes of each level passed.

    `count` is the number of nodes that the whole tree has on this level: a tree's only node has no parent.
    """
    levels = []
    while count > 1 and len(levels) < most:
        levels.append(nodes)
        nodes = [_digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        count = -(-count // fanout)
    return nodes[0], levels


def _siblings(levels: list[list[str]], place: int, fanout: int) -> Iterator[tuple[str, str]]:
    """Of every level the digests left and right of the node's own in its run."""
    for nodes in levels:
        first = place - place % fanout
        yield "".join(nodes[first:place]), "".join(nodes[place + 1 : first + fanout])
        place //= fanout


class _Proofs:
    """Lists of (left, right) as an Arrow array."""

    def __init__(self):
        self.lefts, self.rights, self.offsets = [], [], [0]

    def add(self, *parts) -> None:
        for part in parts:
            for left, right in part:
                self.lefts.append(left)
                self.rights.append(right)
        self.offsets.append(len(self.lefts))

    def array(self) -> pa.Array:
        pairs = pa.StructArray.from_arrays([pa.array(self.lefts, pa.string()), pa.array(self.rights, pa.string())], ["left", "right"])
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pairs)


def _pairs(levels: list[dict] | None) -> list[tuple[str, str]]:
    return [(x["left"], x["right"]) for x in levels or []]


# ----------------------------------------------------------------------------- leaves
def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each value as its number of UTF-8 bytes, a colon and itself, or `-` where it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _placed(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`nodes` with `_pos`, the 0-based place in its tree, and `_total`, the tree's number of leaves.

    Range partitions hold runs of trees; a run's first place is the sum of the tree's rows in the partitions
    before, so what is summed up is one row per partition and run. Rows that are equal in tree, order and leaf are dealt
    by a number drawn and written before.
    """
    by = [tree, *order, "_leaf", "_spread"]
    drawn = written(nodes.withColumn("_spread", F.rand(7)), "leaves")
    rows = written(
        drawn.repartitionByRange(*by).sortWithinPartitions(*by).drop("_spread").withColumn("_row", F.monotonically_increasing_id()),
        "ordered-leaves",
    ).withColumn("_part", F.shiftright("_row", 33))
    runs = rows.groupBy("_part", tree).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    same = Window.partitionBy(tree)
    runs = runs.select(
        F.col("_part").alias("_run_part"),
        F.col(tree).alias("_run_tree"),
        (F.sum("_n").over(same.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(same).alias("_total"),
    )
    return (
        rows.join(runs, (F.col("_part") == F.col("_run_part")) & F.col(tree).eqNullSafe(F.col("_run_tree")))
        .withColumn("_pos", F.col("_row") + F.col("_shift"))
        .drop("_row", "_part", "_run_part", "_run_tree", "_shift")
    )


def _blocks(nodes: DataFrame, tree: str, order: list[str], fanout: int) -> DataFrame:
    """One row per aligned block: tree, _total, _block, _items in order, and _node, the block's subtree root."""
    exponent = _power(fanout, BLOCK_LEAVES)
    payload = [c for c in nodes.columns if c not in (tree, "_leaf")]
    placed = _placed(nodes, tree, order)
    gathered = placed.groupBy(tree, "_total", F.expr(f"_pos DIV {fanout**exponent}").alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_leaf", *payload))).alias("_items")
    )
    items = gathered.columns.index("_items")

    def roots(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, found = batch.column(items), []
        for row, total in zip(range(batch.num_rows), batch.column(1).to_pylist()):
            leaves = [x.hex() for x in column.slice(row, 1).flatten().field("_leaf").to_pylist()]
            found.append(bytes.fromhex(_climb(leaves, total, fanout, exponent)[0]))
        return batch.append_column("_node", pa.array(found, pa.binary()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in gathered.schema.fields)
    return written(gathered.mapInArrow(by_batch(roots), f"{fields}, _node binary"), "leaf-blocks")


# -------------------------------------------------------------------------- butterfly
def _swap(state: DataFrame, tree: str, round_: int, fanout: int) -> DataFrame:
    """One round: blocks whose numbers differ only in digit `round_` (base: the group's size) swap their nodes.

    Where a tree's last node covers fewer blocks than the others, its blocks in turn also stand in for
    the missing ones, so that every group has one row per node and no block sends to more than its share.
    """
    exponent = _power(fanout, GROUP_BLOCKS)
    group, strands = fanout**exponent, (fanout**exponent) ** round_
    last = f"((_blocks - 1) DIV {strands})"
    there = f"(_blocks - {last} * {strands})"
    sent = (
        state.withColumn("_place", F.expr(f"_block DIV {strands}"))
        .withColumn("_own", F.expr(f"_block % {strands}"))
        .withColumn(
            "_strand",
            F.explode(
                F.expr(f"CASE WHEN {last} > 0 AND _place = {last} THEN sequence(_own, {strands - 1}L, {there}) ELSE array(_own) END")
            ),
        )
    )
    real = F.col("_strand") == F.col("_own")
    member = F.struct(
        (F.col("_place") % group).alias("digit"),
        F.when(real, F.col("_block")).alias("block"),
        F.col("_node").alias("node"),
        F.when(real, F.col("_levels")).alias("levels"),
    )
    groups = sent.groupBy(tree, "_blocks", F.expr(f"_place DIV {group}").alias("_group"), "_strand").agg(F.collect_list(member).alias("_members"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, sizes, blocks, nodes, proofs = [], [], [], [], _Proofs()
            for name, size, members in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4))):
                members.sort(key=lambda m: m["digit"])
                root, levels = _climb([m["node"].hex() for m in members], -(-size // strands), fanout, exponent)
                for place, m in enumerate(members):
                    if m["block"] is not None:
                        trees.append(name)
                        sizes.append(size)
                        blocks.append(m["block"])
                        nodes.append(bytes.fromhex(root))
                        proofs.add(_pairs(m["levels"]), _siblings(levels, place, fanout))
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees, batch.schema.field(0).type), pa.array(sizes, pa.int64()), pa.array(blocks, pa.int64()), pa.array(nodes, pa.binary()), proofs.array()],
                [tree, "_blocks", "_block", "_node", "_levels"],
            )

    kind = state.schema[tree].dataType.simpleString()
    return groups.mapInArrow(meet, f"`{tree}` {kind}, _blocks long, _block long, _node binary, _levels {_LEVELS}")


def _butterfly(blocks: DataFrame, tree: str, fanout: int) -> DataFrame:
    """(tree, _block, _node: the tree's root, _levels: the proof from the block's root up to it)."""
    size, group = fanout ** _power(fanout, BLOCK_LEAVES), fanout ** _power(fanout, GROUP_BLOCKS)
    state = blocks.select(tree, F.expr(f"(_total + {size - 1}) DIV {size}").alias("_blocks"), "_block", "_node", F.expr(f"CAST(array() AS {_LEVELS})").alias("_levels"))
    most, rounds = state.agg(F.max("_blocks")).first()[0] or 0, 0
    while group**rounds < most:
        state = written(_swap(state, tree, rounds, fanout), "swapped")
        rounds += 1
    return state


def _unfolded(rows: DataFrame, tree: str, fanout: int, kept: list[str]) -> DataFrame:
    """Block rows with _levels to one row per leaf: tree, payload, _proof, and the block's `kept` columns."""
    exponent = _power(fanout, BLOCK_LEAVES)
    given = rows.select(tree, "_total", "_items", "_levels", *kept)
    inner = [f for f in given.schema["_items"].dataType.elementType.fields if f.name != "_pos"]

    def unfold(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, proofs, owner = batch.column(2), _Proofs(), []
        totals, upper = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        for row in range(batch.num_rows):
            leaves = [x.hex() for x in column.slice(row, 1).flatten().field("_leaf").to_pylist()]
            _, levels = _climb(leaves, totals[row], fanout, exponent)
            above = _pairs(upper[row])
            for place in range(len(leaves)):
                proofs.add(_siblings(levels, place, fanout), above)
            owner.extend([row] * len(leaves))
        items, at = column.flatten(), pa.array(owner, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), *(items.field(f.name) for f in inner), proofs.array(), *(batch.column(4 + k).take(at) for k in range(len(kept)))],
            [tree, *(f.name for f in inner), "_proof", *kept],
        )

    fields = [given.schema[tree], *inner, *(given.schema[c] for c in kept)]
    named = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in fields}
    schema = ", ".join([named[tree], *(named[f.name] for f in inner), f"_proof {_LEVELS}", *(named[c] for c in kept)])
    return given.mapInArrow(by_batch(unfold), schema)


# -------------------------------------------------------------------------- interface
def prove(leaves: DataFrame, tree: str, order: list[str], leaf_col: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """The rows of `leaves` with `proof`, `subroot` and `root`.

    Leaves of one value of `tree` (null is a value of its own, cast to text) ascend by `order`, nulls first, then by
    digest. While a level has several nodes, every `fanout` consecutive ones, at the end of a level fewer and even one,
    become the digest of their digests in lowercase hex. What remains is the subroot; a lone leaf is its own. The subroots, ascending by
    `tree` (null first, UTF-8 bytewise), give the root in the same way. `proof` lists from leaf to root the concatenated
    digests left and right of the own node in its run (both empty where it stands alone). Repeated rows are leaves of
    their own. An empty table gives an empty result. `leaf_col` is binary.
    """
    ready(leaves.sparkSession)
    columns = [c for c in leaves.columns if c != leaf_col]
    inner = {c: f"p{i}" for i, c in enumerate(columns)}
    named = leaves.select(
        F.col(f"`{tree}`").cast("string").alias("_tree"), F.col(f"`{leaf_col}`").alias("_leaf"), *[F.col(f"`{c}`").alias(p) for c, p in inner.items()]
    )
    blocks = _blocks(named, "_tree", [inner[c] for c in order], fanout)
    state = _butterfly(blocks, "_tree", fanout)
    subroots = state.filter("_block = 0").select(F.lit("all").alias("_all"), F.col("_tree").alias("_name"), F.col("_node").alias("_leaf"), "_blocks")
    tops = _blocks(subroots, "_all", ["_name"], fanout)
    above = _butterfly(tops, "_all", fanout).select("_all", "_block", "_levels", F.col("_node").alias("_root"))
    # The upper proofs, once per chunk of a tree's blocks, so that a large tree's blocks have many keys to meet them.
    chunks = _unfolded(tops.drop("_node").join(above, ["_all", "_block"]), "_all", fanout, ["_root"]).select(
        F.col("_name"),
        F.col("_proof").alias("_top"),
        "_root",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_blocks - 1) DIV {CHUNK_BLOCKS}"))).alias("_chunk"),
    )
    in_chunk = F.col("_tree").eqNullSafe(F.col("_name")) & (F.expr(f"_block DIV {CHUNK_BLOCKS}") == F.col("_chunk"))
    proofs = state.join(chunks, in_chunk).select(
        F.col("_tree").alias("_name"), F.col("_block").alias("_number"), F.concat("_levels", "_top").alias("_levels"), F.col("_node").alias("_subroot"), "_root"
    )
    rows = blocks.drop("_node").join(proofs, F.col("_tree").eqNullSafe(F.col("_name")) & (F.col("_block") == F.col("_number")))
    text = {c: F.lower(F.hex(f"_{c}")).alias(c) for c in ("leaf", "subroot", "root")}
    return _unfolded(rows, "_tree", fanout, ["_subroot", "_root"]).select(
        *[F.col(p).alias(c) for c, p in inner.items()], text["leaf"], F.col("_proof").alias("proof"), text["subroot"], text["root"]
    )


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest (lowercase hex) and its proof give."""
    return F.aggregate(proof, start, lambda own, level: F.sha2(F.concat(level["left"], own, level["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all digests of a proof, from leaf to root, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda level: F.concat(level["left"], level["right"]))), 256)


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf after one is added to n_chars, for a seventh of the ids (7 divides their crc32); null for all others."""
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    changed = leaf([more if c == "n_chars" else F.col(c) for c in FIELDS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(chosen, changed)


def verify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: proofs of all rows, and which rows a tampered copy still matches.

    A null id is never tampered with; a null n_chars stays null. Other columns than the five of `documents` are ignored.
    """
    leaves = docs.select("doc_id", "lang", leaf([F.col(c) for c in FIELDS]).alias("leaf"), tampered_leaf(docs).alias("changed"))
    proved = prove(leaves, "lang", ["doc_id"])
    found = F.coalesce(F.lower(F.hex("changed")), F.col("leaf"))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(found, F.col("proof")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
