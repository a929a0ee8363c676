"""SentencePiece BPE encoding by vectorised merge rounds.

A text becomes units (a run of space markers and the characters up to the next
marker); no piece of the vocabulary reaches over a unit's end, so units merge
independently and each distinct one is merged once. All units that are not yet
known are merged together: one flat array of symbols, in every round the best
pair of each unit is found by a segmented minimum over pair ranks, merged at its
leftmost place (at all its places where that cannot change the order of merges),
and the array is compacted, until no unit has a pair left.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm.common import by_batch, ready, whole_text

MARKER = "▁"
_UNITS = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
_NO_RANK = np.int64(1) << 40

# Units a Python worker remembers; beyond that it starts anew.
REMEMBERED_UNITS = 400_000
UNITS_AT_ONCE = 10_000


class PieceBpe:
    """Encodes texts with a BPE model file of the sentencepiece library."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib = self.library
        special = {i for i in range(len(lib)) if lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) or lib.is_unused(i)}
        pieces = {lib.id_to_piece(i): i for i in range(len(lib)) if i not in special}
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("a piece of this vocabulary reaches over a space marker; its units are not independent")
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.bytes = {lib.id_to_piece(i): i for i in range(len(lib)) if lib.is_byte(i)}
        self.byte_ids = [self.bytes.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        # Symbols below len(lib) are pieces; a character that is no piece gets a number above 2^31.
        self.pieces = pieces
        order = {p: r for r, p in enumerate(sorted(pieces, key=lambda p: (-lib.get_score(pieces[p]), pieces[p])))}
        scores = {}
        lefts, rights, merged, ranks = [], [], [], []
        for piece, number in pieces.items():
            # Pieces of one score share a rank, as the library compares scores.
            rank = scores.setdefault(lib.get_score(number), order[piece])
            scores[lib.get_score(number)] = min(rank, order[piece])
        for piece, number in pieces.items():
            for cut in range(1, len(piece)):
                left, right = self._symbol(piece[:cut]), self._symbol(piece[cut:])
                if left is not None and right is not None:
                    lefts.append(left)
                    rights.append(right)
                    merged.append(number)
                    ranks.append(scores[lib.get_score(number)])
        keys = (np.array(lefts, np.uint64) << np.uint64(32)) | np.array(rights, np.uint64)
        by_key = np.argsort(keys)
        self.pair_keys = keys[by_key]
        self.pair_ids = np.array(merged, np.int64)[by_key]
        self.pair_ranks = np.array(ranks, np.int64)[by_key]
        self.known: dict[str, bytes] = {}

    def _symbol(self, text: str) -> int | None:
        number = self.pieces.get(text)
        if number is None and len(text) == 1:
            return (1 << 31) + ord(text)
        return number

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; no rank where it makes none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        if not len(self.pair_keys):
            return np.full(len(keys), _NO_RANK), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], _NO_RANK), np.where(hit, self.pair_ids[at], 0)

    def _ranked(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made piece of the pairs that begin at `at`; a unit's last symbol begins none."""
        right = np.minimum(at + 1, len(symbols) - 1)
        rank, made = self._pairs(symbols[at], symbols[right])
        rank[(owner[at] != owner[right]) | (at == right)] = _NO_RANK
        return rank, made

    def merge_units(self, units: list[str]) -> list[bytes]:
        """The ids of every unit after all merges, as little-endian unsigned 32-bit integers."""
        letters, which = np.unique(np.frombuffer("".join(units).encode("utf-32-le"), "<u4"), return_inverse=True)
        symbols = np.array([self._symbol(chr(c)) for c in letters.tolist()], np.int64)[which]
        owner = np.repeat(np.arange(len(units)), [len(unit) for unit in units])
        rank, made = self._ranked(symbols, owner, np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            best = np.minimum.reduceat(rank, starts)
            goal = np.repeat(best, sizes)
            ended = goal == _NO_RANK
            done.append((owner[ended], symbols[ended]))
            at = np.flatnonzero((rank == goal) & ~ended)
            take = self._places(symbols, owner, rank, made, at)
            # Merge and compact: the left symbol becomes the piece, the right one goes.
            keep = ~ended
            keep[take + 1] = False
            symbols[take] = made[take]
            changed = np.zeros(len(symbols), bool)
            changed[take] = True
            changed[np.maximum(take - 1, 0)] = True
            changed[np.maximum(take - 2, 0)] |= ~keep[np.maximum(take - 1, 0)]
            symbols, owner, rank, made, changed = symbols[keep], owner[keep], rank[keep], made[keep], changed[keep]
            if len(symbols):
                again = np.flatnonzero(changed)
                rank[again], made[again] = self._ranked(symbols, owner, again)
        if not done:
            return []
        owner, symbols = (np.concatenate(x) for x in zip(*done))
        in_order = np.argsort(owner, kind="stable")
        owner, ids = self._ids(owner[in_order], symbols[in_order])
        ends = (4 * np.searchsorted(owner, np.arange(len(units)), "right")).tolist()
        flat = ids.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _places(self, symbols, owner, rank, made, at) -> np.ndarray:
        """Where to merge in this round, given all places with the best rank of their unit.

        Of each unit the leftmost place, and with it all further places if no merge among
        them can make a pair that ranks as good or better, which would have to go first.
        """
        new_unit = np.r_[True, owner[at][1:] != owner[at][:-1]][: len(at)]
        if new_unit.all():
            return at
        leading = at[new_unit]
        # Overlapping places (as in aaa): of a run of adjacent places every second one counts.
        run_start = np.r_[True, (at[1:] != at[:-1] + 1) | new_unit[1:]]
        first = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
        several = at[(np.arange(len(at)) - first) % 2 == 0]
        many = np.isin(owner[several], owner[at[~new_unit]])
        several = several[many]
        after = symbols.copy()
        after[several] = made[several]
        risky = np.zeros(len(several), bool)
        last = len(symbols) - 1
        for offset in (-2, -1, 2):
            beside = np.clip(several + offset, 0, last)
            for state in (symbols, after):
                pair = (state[beside], after[several]) if offset < 0 else (after[several], state[beside])
                got, _ = self._pairs(*pair)
                risky |= (got <= rank[several]) & (owner[beside] == owner[several])
        several = several[~np.isin(owner[several], owner[several[risky]])]
        return np.union1d(leading, several)

    def _ids(self, owner: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids; a character that is no piece becomes the ids of its bytes."""
        strange = symbols >> 31 > 0
        if not strange.any():
            return owner, symbols
        spelled = {
            s: [self.byte_ids[b] for b in chr(s - (1 << 31)).encode("utf-8")] if self.bytes else [self.unknown]
            for s in np.unique(symbols[strange]).tolist()
        }
        odd = [spelled[s] for s in symbols[strange].tolist()]
        counts = np.ones(len(symbols), np.int64)
        counts[strange] = [len(x) for x in odd]
        ids = np.repeat(symbols, counts)
        ids[np.repeat(strange, counts)] = [i for x in odd for i in x]
        return np.repeat(owner, counts), ids

    def units(self, text: str) -> list[str]:
        return _UNITS.findall(MARKER + text.replace(" ", MARKER)) if text else []

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, with begin and end ids, as little-endian unsigned 32-bit integers."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        split = [self.units(text) for text in texts]
        if len(self.known) > REMEMBERED_UNITS:
            self.known.clear()
        missing = list(set().union(*split) - self.known.keys())
        for start in range(0, len(missing), UNITS_AT_ONCE):
            some = missing[start : start + UNITS_AT_ONCE]
            self.known.update(zip(some, self.merge_units(some)))
        return [begin + b"".join(map(self.known.__getitem__, units)) + end for units in split]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def _model(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (binary, little-endian unsigned 32-bit, with begin and end ids), n_tokens, decoded.

    Null texts count as empty: begin and end id, decoded to an empty text. Ids may be
    null or repeated; every row is encoded by itself. Other columns are ignored. Runs in
    the scan tasks without a shuffle; equal units of a worker's texts are merged once.
    """
    ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _model(model_path)
        encoded = model.encode_batch(batch.column(1).to_pylist())
        decoded = [model.decode(np.frombuffer(ids, "<u4")) for ids in encoded]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(encoded, pa.binary()),
                pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                pa.array(decoded, pa.string()),
            ],
            ["_id", "ids", "n_tokens", "decoded"],
        )

    given = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = f"_id {given.schema['_id'].dataType.simpleString()}, ids binary, n_tokens long, decoded string"
    return given.mapInArrow(by_batch(run), schema).withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`encode_decode` with digests in place of ids and decoded texts, so that neither leaves the task."""
    ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _model(model_path)
        encoded = model.encode_batch(batch.column(1).to_pylist())
        sha = hashlib.sha256
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                pa.array([sha(ids).hexdigest() for ids in encoded], pa.string()),
                pa.array(
                    [sha(model.decode(np.frombuffer(ids, "<u4")).encode("utf-8")).hexdigest() for ids in encoded],
                    pa.string(),
                ),
            ],
            ["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    given = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = f"_id {given.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return given.mapInArrow(by_batch(run), schema).withColumnRenamed("_id", id_col)
