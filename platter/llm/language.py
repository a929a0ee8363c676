"""Language identification by language-bitmask n-gram filters.

Every slot of the filter is a bitmask of languages (a Bloom filter per language, stored
bit-sliced), so a few reads return all languages that contain an n-gram. A document's
n-grams add up to one count per language; counts are corrected for the filter's known
rate of false positives, and the largest share decides.

Languages that are rare in what is learned from are as many as the data has, so their n-grams stay a table. A second filter
bounds what share of a text's n-grams a rare language can have; texts for which that is more than the best
share join the table, and the exact count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import by_batch, plain_names, ready, whole_text, written

ORDERS = (3, 4)
# An n-gram belongs to a language if it makes up this share of the language's n-grams, so that a
# language has at most 1 / MIN_SHARE of them, and if it is not much rarer than in another language.
MIN_SHARE = 1e-5
MIN_RELATIVE = 0.1
SLOTS = 1 << 21
HASHES = 3
# Code points that are handled at once; longer texts are counted in pieces of so many n-gram beginnings.
AT_ONCE = 1 << 19
# A language with this share of all n-grams learned from is in the filter, so that it holds at most 1 / LEAST_LANGUAGE of them.
LEAST_LANGUAGE = 1 / 1024
# The other languages are dealt into so many groups; a group has a bit in the second filter.
RARE_GROUPS = 32
# Entries of a task's table of counts before it is sent on.
TABLE_SIZE = 1 << 20

UNKNOWN = "und"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_LETTERS = np.array([chr(c).isalpha() for c in range(0x10000)])


def held_out(id_col: str) -> Column:
    """True for the quarter of the ids that learning must not see; a null id is not held out."""
    checksum = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(checksum % 4 == 2, F.lit(False))


def _codes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the pieces as numbers, all else zero; and where pieces begin."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    wide = codes >= 0x10000
    letter = _LETTERS[np.where(wide, 0, codes)]
    if wide.any():
        letter[wide] = [chr(c).isalpha() for c in codes[wide].tolist()]
    codes[~letter] = 0
    return codes, np.r_[0, np.cumsum([len(p) for p in pieces])[:-1]]


def _grams(codes: np.ndarray, order: int, begin: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the n-gram that begins at every place, and whether there is one: letters only,
    with a word's edge allowed at either end. Only the first `begin` places count, if given."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    hashes = np.full(n, order, np.uint64)
    valid = np.ones(n, bool)
    for k in range(order):
        part = codes[k : k + n]
        hashes = hashes * _PRIME + part
        if 0 < k < order - 1:
            valid &= part > 0
    valid[begin if begin is not None else n :] = False
    hashes ^= hashes >> np.uint64(29)
    return hashes * np.uint64(_MIXERS[0]), valid


def _portions(texts: list[str]) -> Iterator[tuple[list[int], list[str], int | None]]:
    """(numbers of texts, pieces, beginnings) with about AT_ONCE code points.

    Texts are in lower case with an edge at either end, so that no n-gram reaches from one into the next. A text
    longer than AT_ONCE comes in pieces of its own, which overlap: only n-grams among the first `beginnings` places count.
    """
    numbers, some, size = [], [], 0
    for i, text in enumerate(texts):
        bounded = f"\0{text.lower()}\0"
        if len(bounded) > AT_ONCE:
            for start in range(0, len(bounded), AT_ONCE):
                yield [i], [bounded[start : start + AT_ONCE + max(ORDERS) - 1]], AT_ONCE
            continue
        numbers.append(i)
        some.append(bounded)
        size += len(bounded)
        if size >= AT_ONCE:
            yield numbers, some, None
            numbers, some, size = [], [], 0
    if some:
        yield numbers, some, None


def _text_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one text and their counts."""
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _, some, begin in _portions([text]):
        codes, _ = _codes(some)
        for order in ORDERS:
            found, valid = _grams(codes, order, begin)
            own, n = np.unique(found[valid], return_counts=True)
            grams, at = np.unique(np.concatenate([grams, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), minlength=len(grams)).astype(np.int64)
    return grams, counts


def _slots(grams: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        mixed = grams * np.uint64(_MIXERS[k + 1])
        yield (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, gram, n), combined inside the task."""
    tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def send() -> Iterator[pa.RecordBatch]:
        for lang, (grams, counts) in tables.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)],
                ["lang", "gram", "n"],
            )
        tables.clear()

    for batch in batches:
        langs, texts = (np.array(c.to_pylist(), object) for c in batch.columns)
        for lang in sorted(set(langs)):
            for _, some, begin in _portions(texts[langs == lang].tolist()):
                codes, _ = _codes(some)
                found = [grams[valid] for grams, valid in (_grams(codes, order, begin) for order in ORDERS)]
                grams, counts = np.unique(np.concatenate(found), return_counts=True)
                if lang in tables:
                    both = np.concatenate([tables[lang][0], grams])
                    grams, at = np.unique(both, return_inverse=True)
                    counts = np.bincount(at, np.concatenate([tables[lang][1], counts])).astype(np.int64)
                tables[lang] = grams, counts.astype(np.int64)
        if sum(len(g) for g, _ in tables.values()) > TABLE_SIZE:
            yield from send()
    yield from send()


@dataclass
class Model:
    """languages in order; slices: (languages / 8, SLOTS) bytes, a bit per language; rates of false positives.

    rare: (lang, gram) of the languages that are not in `slices`; rare_bits: a bit per group of them in every slot. None without such languages.
    """

    languages: list[str]
    slices: np.ndarray
    false_rate: np.ndarray
    default: str | None
    rare: DataFrame | None = None
    rare_bits: np.ndarray | None = None

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Of each n-gram the languages that contain it, as bits."""
        found = np.full((len(self.slices), len(grams)), 255, np.uint8)
        for slot in _slots(grams):
            found &= self.slices[:, slot]
        return found

    def rare_groups(self, grams: np.ndarray) -> np.ndarray:
        """Of each n-gram the groups of rare languages that may contain it, as bits."""
        found = np.full(len(grams), (1 << RARE_GROUPS) - 1, np.uint32)
        for slot in _slots(grams):
            found &= self.rare_bits[slot]
        return found

    def rare_bounds(self, texts: list[str]) -> np.ndarray:
        """Per text a share of its n-grams that no rare language exceeds."""
        counts, total = np.zeros((len(texts), RARE_GROUPS)), np.zeros(len(texts))
        for numbers, some, begin in _portions(texts):
            codes, starts = _codes(some)
            for order in ORDERS:
                grams, valid = _grams(codes, order, begin)
                owner = np.array(numbers)[np.searchsorted(starts, np.flatnonzero(valid), "right") - 1]
                groups = self.rare_groups(grams[valid])
                total += np.bincount(owner, minlength=len(texts))
                hit = groups > 0
                owner, groups = owner[hit], groups[hit]
                for i in np.flatnonzero([(groups >> np.uint32(i) & 1).any() for i in range(RARE_GROUPS)]):
                    counts[:, i] += np.bincount(owner, groups >> np.uint32(i) & 1, minlength=len(texts))
        return counts.max(axis=1, initial=0) / np.maximum(total, 1)

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the corrected share of its n-grams in every language, and whether it has a letter."""
        counts = np.zeros((len(texts), len(self.languages)))
        total, letters = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for numbers, some, begin in _portions(texts):
            codes, starts = _codes(some)
            np.logical_or.at(letters, numbers, np.logical_or.reduceat(codes > 0, starts))
            for order in ORDERS:
                grams, valid = _grams(codes, order, begin)
                if not valid.any():
                    continue
                owner = np.searchsorted(starts, np.flatnonzero(valid), "right") - 1
                owner = np.array(numbers)[owner]
                masks = self.masks(grams[valid])
                total += np.bincount(owner, minlength=len(texts))
                for i in range(len(self.languages)):
                    bit = (masks[i // 8] >> (i % 8)) & 1
                    counts[:, i] += np.bincount(owner, bit, minlength=len(texts))
        size = np.maximum(total, 1)[:, None]
        return np.clip((counts / size - self.false_rate) / (1 - self.false_rate), 0, 1), letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        shares, letters = self.shares([t or "" for t in texts])
        if not self.languages:
            return [UNKNOWN if self.default is None or not has else self.default for has in letters.tolist()], [0.0] * len(texts)
        best = shares.argmax(axis=1)
        top = shares[np.arange(len(texts)), best]
        names = [
            UNKNOWN if not has else self.languages[b] if s > 0 else self.default
            for has, b, s in zip(letters.tolist(), best.tolist(), top.tolist())
        ]
        return names, np.where(letters, top, 0.0).tolist()


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model from all rows with a text and a language; without such rows it knows no language.

    What reaches the driver is one row per n-gram kept, at most 1 / MIN_SHARE per language, of the languages with at least
    LEAST_LANGUAGE of all n-grams. They lose no n-gram to a rarer language. The n-grams of all other languages stay a table,
    `rare`; of these the driver gets at most SLOTS rows.
    """
    spark = ready(labelled.sparkSession)
    given = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    counts = written(
        given.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "language-counts",
    )
    every = counts.agg(F.sum("n").alias("every"))
    sized = counts.groupBy("lang").agg(F.sum("n").alias("total")).crossJoin(every)
    totals = written(sized.select("lang", "total", (F.col("total") >= F.col("every") * LEAST_LANGUAGE).alias("common")), "language-totals")
    sizes = {r.lang: r.total for r in totals.filter("common").collect()}
    most = totals.orderBy(F.desc("total"), F.desc("lang")).first()

    def kept(languages: DataFrame) -> DataFrame:
        shares = counts.join(languages, "lang").select("lang", "gram", "common", (F.col("n") / F.col("total")).alias("share"))
        shares = shares.filter(F.col("share") >= MIN_SHARE)
        top = shares.groupBy("gram").agg(F.max("share").alias("top"))
        return shares.join(top, "gram").filter(F.col("share") >= MIN_RELATIVE * F.col("top")).select("lang", "gram", "common")

    common = kept(totals.filter("common")).select("lang", "gram").toArrow()
    languages = sorted(sizes)
    slices = np.zeros((max(-(-len(languages) // 8), 1), SLOTS), np.uint8)
    model = Model(languages, slices, np.zeros(len(languages)), most and most.lang)
    names = np.array(common.column("lang").to_pylist(), object)
    grams = common.column("gram").to_numpy().view(np.uint64)
    for i, language in enumerate(languages):
        for slot in _slots(grams[names == language]):
            slices[i // 8, slot] |= np.uint8(1 << (i % 8))
        model.false_rate[i] = np.count_nonzero(slices[i // 8] & np.uint8(1 << (i % 8))) / SLOTS
    model.false_rate **= HASHES
    if not totals.filter("NOT common").isEmpty():
        model.rare = written(kept(totals).filter("NOT common").select("lang", "gram"), "rare-languages")
        model.rare_bits = _rare_bits(model.rare)
    return model


def _rare_bits(rare: DataFrame) -> np.ndarray:
    """Of every slot the groups of rare languages with an n-gram there, as bits."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            own = np.uint32(1) << batch.column(1).to_numpy().astype(np.uint32)
            for slot in _slots(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(bits, slot, own)
        used = np.flatnonzero(bits)
        for at in np.split(used, range(1 << 16, len(used), 1 << 16)):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bits[at].astype(np.int64))], ["slot", "bits"])

    grouped = rare.select("gram", F.pmod(F.xxhash64("lang"), F.lit(RARE_GROUPS)).alias("group"))
    found = grouped.mapInArrow(fill, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(SLOTS, np.uint32)
    bits[found.column("slot").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return bits


def _rare_answers(texts: DataFrame, model: Model) -> DataFrame:
    """(_digest, _lang, _share) of the texts in which a rare language has a larger share than all languages of the filter.

    `texts` has _digest and _text; equal texts count once. Only n-grams that may be in a rare language are shuffled, and only
    those of texts that the filter leaves open. Of equal shares the first language by name counts.
    """
    shared = texts.sparkSession.sparkContext.broadcast(replace(model, rare=None))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, known = [t or "" for t in batch.column(1).to_pylist()], shared.value
            scores = np.array(known.predict(some)[1])
            for i in np.flatnonzero(known.rare_bounds(some) > scores):
                grams, counts = _text_grams(some[i])
                hit = known.rare_groups(grams) > 0
                n, total = int(hit.sum()), int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n, pa.string()), pa.array(grams[hit].view(np.int64)), pa.array(counts[hit]),
                        pa.array([total] * n, pa.int64()), pa.array([scores[i]] * n, pa.float64()),
                    ],
                    ["_digest", "gram", "n", "total", "score"],
                )

    asked = texts.select("_digest", "_text").mapInArrow(ask, "_digest string, gram long, n long, total long, score double").distinct()
    shares = (
        asked.join(model.rare, "gram")
        .groupBy("_digest", "lang", "total", "score")
        .agg((F.sum("n") / F.col("total")).alias("share"))
        .filter("share > score")
    )
    best = shares.groupBy("_digest").agg(F.min(F.struct((-F.col("share")).alias("less"), "lang")).alias("best"))
    return written(best.select("_digest", F.col("best.lang").alias("_lang"), (-F.col("best.less")).alias("_share")), "rare-answers")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with `lang_pred` and `score` in place of any such columns.

    `und` and score 0 where the text is null or has no letter, or the model knows no language.
    A text whose n-grams are in no language gets the most learned language with score 0. A rare language needs a larger share than
    those of the filter; its share is exact.
    Repeated rows get equal answers and an empty table gives an empty result. Whole texts count; a tie goes to the first language by name. Only the text is looked at.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(replace(model, rare=None))
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    place = kept.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(batch.column(place).to_pylist())
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            [*batch.schema.names, "lang_pred", "score"],
        )

    given = plain_names(docs.select(*[F.col(f"`{c}`") for c in kept]))
    if model.rare is not None:
        given = given.withColumn("_digest", F.sha2(whole_text(f"p{place}").cast("binary"), 256))
        answers = _rare_answers(given.select("_digest", F.col(f"p{place}").alias("_text")), model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    told = given.mapInArrow(by_batch(run), f"{fields}, lang_pred string, score double")
    if model.rare is not None:
        told = told.join(answers, "_digest", "left").select(
            *[f"p{i}" for i in range(len(kept))],
            F.coalesce("_lang", "lang_pred").alias("lang_pred"),
            F.coalesce("_share", "score").alias("score"),
        )
    return told.toDF(*kept, "lang_pred", "score")
