"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model of a language is counted on trusted text: counts of the longest n-grams,
continuation counts below, discounts from the counts of counts. All tables are keyed by
(language, n-gram) and stay sharded. To score, documents are packed into blocks; a block asks once
for each distinct n-gram that it holds, the requests of all blocks are made distinct and
joined with the model's tables, longest order first, and the answers go back to the
blocks, where every document adds up its own log probabilities. A document passes if its
perplexity is within a quantile of the perplexities of held-out trusted documents of its language.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platter.llm.common import ready, whole_text, written
from platter.session import scratch_path

ORDER = 5
# Bytes of a block before compression; a single longer text makes a block of its own.
BLOCK_BYTES = 32 << 20
COMPRESSION_LEVEL = 6
# Characters handled at once; a longer text comes in such pieces, each with the context that it goes on from.
AT_ONCE = 1 << 19
# Of the trusted documents one in so many is held out to set the thresholds.
HELD_OUT = 10
QUANTILE = 0.99
# How far above the quantile a perplexity may lie, as a factor: trusted text varies beyond any sample of it.
MARGIN = 1.1

NO_LANGUAGE = "und"
_START = 2  # stands before a text
_MAP_BITS = 32768  # bits of one bitmap of bitmap_construct_agg
_ROWS_AT_ONCE = 1 << 16  # n-grams of one record batch
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _table() -> np.ndarray:
    """Every code point of the basic plane as the model sees it: white space and controls alike, digits alike."""
    table = np.arange(0x10000, dtype=np.uint32)
    table[[c for c in range(0x10000) if chr(c).isspace() or c < 32 or 127 <= c < 160]] = 32
    table[48:58] = 48
    return table


_SEEN_AS = _table()


def _codes(texts: list[str], before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array of symbols, each after ORDER - 1 start symbols, and the owner of each; the
    first text stands after the symbols `before` if it goes on with an earlier piece."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    codes = _SEEN_AS[np.minimum(raw, 0xFFFF)]
    far = raw >= 0x10000
    codes[far] = raw[far]
    space = codes == 32
    again = np.r_[False, space[1:] & space[:-1] & (owner[1:] == owner[:-1])][: len(codes)]
    if before is not None and len(codes) and owner[0] == 0:
        again[0] = space[0] and before[-1] == 32
    if again.any():
        codes, owner = codes[~again], owner[~again]
    # Every symbol moves behind the start symbols of its own text and of those before it.
    sizes = np.bincount(owner, minlength=len(texts)) + ORDER - 1
    owners = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    out = np.full(len(owners), _START, np.uint32)
    out[np.arange(len(codes)) + (ORDER - 1) * (owner + 1)] = codes
    if before is not None:
        out[: ORDER - 1] = before
    return out, owners


def _pieces(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, list[str], bool]]:
    """(numbers of texts, texts, whether the first goes on with the last of the piece before) with about AT_ONCE characters."""
    numbers, some, size, goes_on = [], [], 0, False
    for i, text in enumerate(texts):
        for start in range(0, len(text), AT_ONCE):
            if not some:
                goes_on = start > 0
            numbers.append(i)
            some.append(text[start : start + AT_ONCE])
            size += len(some[-1])
            if size >= AT_ONCE:
                yield np.array(numbers), some, goes_on
                numbers, some, size = [], [], 0
    if some:
        yield np.array(numbers), some, goes_on


def _windows(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, owner, place, symbols) for some texts at a time: the n-grams that end at each character, each being the
    ORDER symbols from its place on."""
    codes = None
    for numbers, some, goes_on in _pieces(texts):
        codes, owner = _codes(some, codes[1 - ORDER :] if goes_on else None)
        n = len(codes) - ORDER + 1
        if n <= 0:  # only white space that follows white space
            continue
        ends = np.flatnonzero(codes[ORDER - 1 :] != _START)
        hashes = np.zeros(n, np.uint64)
        for k in range(ORDER):
            hashes *= _PRIME
            hashes += codes[k : k + n]
            hashes ^= hashes >> np.uint64(32)
        yield hashes[ends], numbers[owner[ends + ORDER - 1]], ends, codes


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, n-gram, count) of every distinct n-gram, from parts of which each has it once at most."""
    hashes = np.concatenate([p[0] for p in parts])
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    grams = np.concatenate([p[1] for p in parts])[order[first]]
    counts = np.concatenate([p[2] for p in parts])[order]
    return hashes[first], grams, np.add.reduceat(counts, first) if len(first) else counts


def _distinct(texts: Iterable[str]) -> tuple[list[str], np.ndarray]:
    """N-grams in order of their symbols and counts of the distinct n-grams of some texts."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, f"<U{ORDER}"), np.zeros(0, np.int64))]
    for found, _, places, codes in _windows(texts):
        order = np.argsort(found)
        found = found[order]
        starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][: len(found)])
        symbols = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[places[order[starts]]]
        names = np.ascontiguousarray(symbols).astype("<u4").view(f"<U{ORDER}")[:, 0]
        parts.append((found[starts], names, np.diff(starts, append=len(found))))
        # What is merged at least doubles what is held, so an n-gram is sorted a few times only.
        if sum(len(p[0]) for p in parts[1:]) > len(parts[0][0]):
            parts = [_merged(parts)]
    _, grams, counts = _merged(parts)
    del parts
    symbols = grams.view("<u4").reshape(-1, ORDER)
    head, tail = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.uint64)
    for k in range(ORDER):
        if k < 3:
            head = head << np.uint64(21) | symbols[:, k].astype(np.uint64)
        else:
            tail = tail << np.uint64(21) | symbols[:, k].astype(np.uint64)
    in_order = np.lexsort((tail, head))  # neighbours that look alike compress well on their way
    return grams[in_order].tolist(), counts[in_order]


def _gram_batches(grams: list[str], **columns: pa.Array | str | int | np.ndarray) -> Iterator[pa.RecordBatch]:
    """Record batches of n-grams with other columns, some rows at a time; a single value stands in every row."""
    for start in range(0, len(grams), _ROWS_AT_ONCE):
        part = pa.array(grams[start : start + _ROWS_AT_ONCE], pa.string())
        others = {k: pa.array(v[start : start + _ROWS_AT_ONCE]) if isinstance(v, np.ndarray) else pa.repeat(v, len(part)) for k, v in columns.items()}
        yield pa.RecordBatch.from_pydict({**others, "gram": part})


def _unpacked(payload: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


class _Block:
    """The rows of a payload, unpacked a record batch at a time whenever they are read."""

    def __init__(self, payload: pa.BinaryScalar):
        self.payload = payload

    def to_batches(self) -> Iterator[pa.RecordBatch]:
        return iter(pa.ipc.open_stream(self.payload.as_buffer()))


class _Texts:
    """Some texts of a block, each made a string when it is its turn."""

    def __init__(self, rows: pa.Table | _Block, at: np.ndarray):
        self.rows, self.at = rows, at

    def __len__(self) -> int:
        return len(self.at)

    def __iter__(self) -> Iterator[str]:
        start = 0
        for batch in self.rows.to_batches():
            own = self.at[slice(*np.searchsorted(self.at, [start, start + batch.num_rows]))] - start
            texts = batch.column("text")
            yield from (texts[i].as_py() for i in own.tolist())
            start += batch.num_rows


def _by_language(rows: pa.Table | _Block) -> Iterator[tuple[str, np.ndarray, _Texts]]:
    """(language, numbers of rows, texts)."""
    langs = np.array([lang for batch in rows.to_batches() for lang in batch.column("lang").to_pylist()], object)
    for lang in sorted(set(langs)):
        at = np.flatnonzero(langs == lang)
        yield lang, at, _Texts(rows, at)


def _keys(grams: pa.ChunkedArray) -> np.ndarray:
    """The hash of each n-gram as in `_windows`."""
    keys = np.zeros(len(grams), np.uint64)
    for start in range(0, len(grams), 1 << 16):
        names = np.array(grams.slice(start, 1 << 16).to_pylist(), f"<U{ORDER}")
        part = keys[start : start + len(names)]
        for k in range(ORDER):
            part[:] = part * _PRIME + names.view("<u4").reshape(-1, ORDER)[:, k]
            part ^= part >> np.uint64(32)
    return keys


class _Places:
    """Places of given hashes among sorted distinct ones, found from the leading bits instead of by bisection."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Every hash must be among the keys."""
        at = self.starts[hashes >> self.shift]
        missed = np.flatnonzero(self.keys[at] != hashes)
        while len(missed):
            at[missed] += 1
            missed = missed[self.keys[at[missed]] != hashes[missed]]
        return at


def _buckets(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions, within Spark's limit for them."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))


def _bucketed(df: DataFrame, name: str, keys: list[str], entries: list[str]) -> DataFrame:
    """The rows of `df` as a table in the shared folder bucketed by `keys`, which joins and groups by them need not shuffle.

    Buckets are known to the catalog only. The name of the entry goes to `entries`, to be dropped when the rows are no longer read.
    """
    spark, entry = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(_buckets(spark), *keys).option("path", scratch_path(spark, name)).format("parquet").saveAsTable(entry)
    entries.append(entry)
    return spark.table(entry)


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, lang_col: str, entries: list[str] | None = None) -> DataFrame:
    """(block, ids, payload): rows of about BLOCK_BYTES, compressed.

    Written once, as blocks must not change, into a table bucketed by block: what is joined
    to the blocks later goes to them, and their payload is never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", COMPRESSION_LEVEL))

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_table(rows)
            ids = pa.array([rows.column("_id").to_pylist()], pa.list_(rows.schema.field("_id").type))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), ids, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "ids", "payload"]
            )

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield block()
                number, held, size = number + 1, [], 0
        if held:
            yield block()

    given = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        whole_text(text_col).alias("text"),
    )
    id_type = given.schema["_id"].dataType.simpleString()
    return _bucketed(given.mapInArrow(run, f"block long, ids array<{id_type}>, payload binary"), "text_blocks", ["block"], [] if entries is None else entries)


def _held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % HELD_OUT == 0


def count_trusted(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """(lang, gram, n): the longest n-grams of the trusted documents, `trusted` being their ids."""
    members = blocks.select("block", F.posexplode("ids").alias("_place", "_id")).join(trusted, "_id", "left_semi")
    # Places count from 1 in these functions. A bit per row of a block: far smaller than the ids, so that the blocks can stay where they are.
    bitmaps = members.groupBy("block", F.expr("bitmap_bucket_number(_place + 1)").alias("number")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_place + 1))").alias("bits")
    )
    chosen = written(bitmaps.groupBy("block").agg(F.collect_list(F.struct("number", "bits")).alias("chosen")), "trusted-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, chosen in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = _unpacked(payload)
                wanted = np.zeros((-(-rows.num_rows // _MAP_BITS), _MAP_BITS), bool)
                for part in chosen:
                    wanted[part["number"] - 1] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), bitorder="little")
                rows = rows.filter(pa.array(wanted.reshape(-1)[: rows.num_rows]))
                for lang, _, texts in _by_language(rows):
                    grams, counts = _distinct(texts)
                    yield from _gram_batches(grams, lang=lang, n=counts)

    counts = blocks.join(chosen, "block").select("payload", "chosen").mapInArrow(run, "lang string, n long, gram string")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(types: DataFrame) -> DataFrame:
    """Per language and order d1, d2, d3 from how many n-grams occur once to four times; where that is too
    little to tell, three quarters as in absolute discounting."""
    n = {k: F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)}
    counted = types.groupBy("lang", "order").agg(*[n[k].alias(f"n{k}") for k in n])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    out = counted
    for k in (1, 2, 3):
        d = F.when(enough, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
        out = out.withColumn(f"d{k}", F.when((d > 0) & (d < k), d).otherwise(F.lit(0.75)))
    return out.select("lang", "order", "d1", "d2", "d3")


def _discount(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def estimate(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Per order: (lang, gram, p) of every n-gram seen, interpolated with all shorter ones, and
    (lang, context, weight), the share that a context leaves to the shorter ones.

    Discounts and contexts of all orders come from one table, so there is one plan for them and a small one per order.
    """
    types = {ORDER: written(counts, f"counts-{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        longer = types[order + 1]
        types[order] = written(
            longer.groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"counts-{order}"
        )
    every = reduce(DataFrame.unionByName, [types[k].withColumn("order", F.lit(k)) for k in types])
    # What follows one context: at most as many n-grams as there are characters.
    same = Window.partitionBy("lang", "context")
    rows = every.join(_discounts(every), ["lang", "order"]).withColumn("context", F.expr("substring(gram, 1, order - 1)"))
    terms = written(
        rows.withColumn("total", F.sum("n").over(same)).withColumn("weight", F.sum(_discount(F.col("n"))).over(same) / F.col("total")).select(
            "lang", "order", "gram", "context", ((F.col("n") - _discount(F.col("n"))) / F.col("total")).alias("own"), "weight"
        ),
        "terms",
    )
    contexts = written(terms.groupBy("lang", "order", "context").agg(F.first("weight").alias("weight")), "contexts")
    uniform = types[1].groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("lower"))
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    for order in range(1, ORDER + 1):
        own = terms.filter(F.col("order") == order).withColumn("suffix", F.substring("gram", 2, order - 1))
        lower = uniform if order == 1 else model[order - 1][0].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        grams = own.join(lower, ["lang"] if order == 1 else ["lang", "suffix"]).select(
            "lang", "gram", (F.col("own") + F.col("weight") * F.col("lower")).alias("p")
        )
        model[order] = written(grams, f"model-{order}"), contexts.filter(F.col("order") == order).select("lang", "context", "weight")
    unseen = model[1][1].join(uniform, "lang").select("lang", (F.col("weight") * F.col("lower")).alias("p"))
    model[0] = unseen, unseen
    return model


def answer(requests: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, gram, logp) of distinct requests (lang, gram). A request that an order has not seen goes on to
    the next shorter one with the weight of its context; languages without a model get no answer."""
    left = requests.withColumn("tail", F.col("gram")).withColumn("backoff", F.lit(0.0))
    found = None
    for order in range(ORDER, 0, -1):
        grams, _ = model[order]
        tried = written(
            left.join(grams.select("lang", F.col("gram").alias("tail"), "p"), ["lang", "tail"], "left"), f"answers-{order}"
        )
        hits = tried.filter("p IS NOT NULL").select("lang", "gram", (F.col("backoff") + F.log("p")).alias("logp"))
        found = hits if found is None else found.unionByName(hits)
        rest = tried.filter("p IS NULL").drop("p")
        if order == 1:
            last = rest.join(model[0][0], "lang").select("lang", "gram", (F.col("backoff") + F.log("p")).alias("logp"))
            return found.unionByName(last)
        contexts = model[order][1].withColumnRenamed("context", "_context")
        left = (
            rest.withColumn("_context", F.substring("tail", 1, order - 1))
            .join(contexts, ["lang", "_context"], "left")
            .select(
                "lang",
                "gram",
                F.substring("tail", 2, order - 1).alias("tail"),
                (F.col("backoff") + F.log(F.coalesce("weight", F.lit(1.0)))).alias("backoff"),
            )
        )
    raise AssertionError


def score(blocks: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]], entries: list[str] | None = None) -> DataFrame:
    """(_id, lang, n_chars, perplexity, text_md5) of every document; null where there is no character or no model."""
    id_field = blocks.schema["ids"].dataType.elementType

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                for lang, _, texts in _by_language(_Block(payload)):
                    grams, _ = _distinct(texts)
                    yield from _gram_batches(grams, block=block, lang=lang)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, langs, sizes, results, digests = [], [], [], [], []
        for payload in left.column("payload"):
            rows = _Block(payload)
            for batch in rows.to_batches():
                ids.append(batch.column("_id"))
                langs.append(batch.column("lang"))
                digests += [hashlib.md5(t.as_buffer()).digest() for t in batch.column("text")]
            size = len(digests) - sum(map(len, sizes))
            chars, perplexity = np.zeros(size, np.int64), np.full(size, np.nan)
            for lang, at, texts in _by_language(rows):
                mine = pc.equal(right.column("lang"), lang)
                keys, logs = _keys(right.column("gram").filter(mine)), right.column("logp").filter(mine).to_numpy()
                by_key = np.argsort(keys)
                keys, logs = keys[by_key], logs[by_key]
                places = _Places(keys) if len(keys) else None
                total, n = np.zeros(len(texts)), np.zeros(len(texts))
                for hashes, owner, _, _ in _windows(texts):
                    n += np.bincount(owner, minlength=len(texts))
                    if places:
                        total += np.bincount(owner, logs[places.of(hashes)], minlength=len(texts))
                chars[at] = n
                if len(keys):
                    perplexity[at] = np.where(n > 0, np.exp(-total / np.maximum(n, 1)), np.nan)
            sizes.append(chars)
            results.append(perplexity)
        return pa.table(
            {
                "_id": pa.chunked_array(ids).combine_chunks(),
                "lang": pa.chunked_array(langs).combine_chunks(),
                "n_chars": np.concatenate(sizes),
                "perplexity": pa.array(np.concatenate(results), from_pandas=True),
                "text_md5": pa.array(digests, pa.binary()),
            }
        )

    # One shuffle by n-gram serves the distinct requests and their way back from the model.
    asked = blocks.select("block", "payload").mapInArrow(ask, "block long, lang string, gram string")
    asked = asked.repartition(_buckets(blocks.sparkSession), "lang", "gram")
    requests = _bucketed(asked, "requests", ["lang", "gram"], [] if entries is None else entries)
    answers = answer(requests.select("lang", "gram").distinct(), model)
    returned = requests.join(answers, ["lang", "gram"]).select("block", "lang", "gram", "logp")
    schema = f"_id {id_field.simpleString()}, lang string, n_chars long, perplexity double, text_md5 binary"
    return (
        blocks.select("block", "payload")
        .groupBy("block")
        .cogroup(returned.groupBy("block"))
        .applyInArrow(add_up, schema)
    )


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    with_digest: bool = False,
) -> DataFrame:
    """One row per row of `docs`: id, lang, n_chars, perplexity, threshold, kept; with_digest adds text_md5.

    `labels` has the id and `quality`; documents of quality 1 are trusted. Nine in ten of them
    train the model of their language, the tenth sets its threshold: the quantile of their
    perplexities times the margin. A null language is a language of its own, `und`. Texts
    without characters (also null ones) have no perplexity and are not kept; documents of
    a language without model or threshold are kept. Repeated ids give a row each. Ids
    that are null are never trusted. Other columns are ignored.
    """
    ready(docs.sparkSession)
    trusted = labels.filter("quality = 1").select(F.col(id_col).alias("_id")).dropna().distinct()
    entries: list[str] = []
    try:
        blocks = pack_blocks(docs, id_col, text_col, lang_col, entries)
        model = estimate(count_trusted(blocks, trusted.filter(~_held_out(F.col("_id")))))
        scored = written(score(blocks, model, entries), "perplexities")
    finally:
        for entry in entries:
            docs.sparkSession.sql(f"DROP TABLE IF EXISTS {entry}")
    measured = scored.join(trusted.filter(_held_out(F.col("_id"))), "_id", "left_semi").filter("perplexity IS NOT NULL")
    thresholds = measured.groupBy("lang").agg(
        (F.percentile_approx("perplexity", quantile, 10000) * margin).alias("threshold")
    )
    return scored.join(thresholds, "lang", "left").select(
        F.col("_id").alias(id_col),
        "lang",
        "n_chars",
        "perplexity",
        "threshold",
        ((F.col("n_chars") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"),
        *(["text_md5"] if with_digest else []),
    )
