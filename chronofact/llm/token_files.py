"""Token files: Simple-8b words in blocks, written in ascending doc_id order.

A file is one row for each block, so that any file system that Spark reaches can
hold it: (shard, block, n_docs, n_ids, doc_ids, doc_sizes, words, escapes).
`words` are little-endian unsigned 64-bit: 4 bits of selector, 60 bits of ids, low
end first. Ids of 2**60 or more would not fit; they stand as zeros whose places and
values are in `escapes`. Blocks decode by themselves: `first_id` is the number of
the shard's ids before the block, and the shard's own start is in the shard table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, materialise
from .tokenise import library_encoder

#: Fixed values of Simple-8b: selector -> (ids in a word, bits of each). Selectors 0 and 1 stand for runs of zeros.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNTS = np.array([n for n, _ in SELECTORS])
BLOCK_IDS = 65_536
#: Beside the sorted texts in an executor's memory the cache of encoded words must be small.
CACHE_WORDS = 300_000


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of non-negative ids; escapes are (place, value) pairs in a row.

    Each word takes the longest run that fits, as far as ids are left. For all places
    at once, the words that could start there are found; then the chain is followed.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    large = np.flatnonzero(ids >= np.uint64(1 << 60))
    escapes = np.stack([large.astype(np.uint64), ids[large]], 1).ravel()
    if len(large):
        ids = ids.copy()
        ids[large] = 0
    if not n:
        return np.empty(0, np.uint64), escapes
    values = ids.astype(np.uint32) if int(ids.max()) < 1 << 32 else ids
    choice = np.full(n, len(SELECTORS) - 1, np.int8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, width = SELECTORS[s]
        fits = values < values.dtype.type(1 << width) if width < 32 else np.ones(n, bool)
        have = 1  # fits[i] says whether `have` ids from i on fit; doubled until it is `count`
        while have < count and len(fits):
            more = min(have, count - have)
            fits = fits[: max(0, len(fits) - more)] & fits[more:]
            have += more
        choice[: len(fits)][fits] = s
    step = _COUNTS[choice].tolist()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(SELECTORS):
        if width and len(at_s := np.flatnonzero(chosen == s)):
            first = starts[at_s]
            for j in range(count):
                words[at_s] |= ids[first + j] << np.uint64(j * width)
    return words, escapes


def decode_words(words: np.ndarray, escapes: np.ndarray = ()) -> np.ndarray:
    """The ids of whole words, selector by selector for all words at once."""
    words = np.asarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(_COUNTS[chosen]) if len(words) else np.zeros(0, np.int64)
    out = np.zeros(int(ends[-1]) if len(words) else 0, np.uint64)
    for s, (count, width) in enumerate(SELECTORS):
        if width and len(at_s := np.flatnonzero(chosen == s)):
            first, mask = ends[at_s] - count, np.uint64((1 << width) - 1)
            for j in range(count):
                out[first + j] = (words[at_s] >> np.uint64(j * width)) & mask
    escapes = np.asarray(escapes, np.uint64).reshape(-1, 2)
    out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out


BLOCK_FIELDS = [("shard", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("doc_null", pa.binary()), ("doc_sizes", pa.binary()), ("words", pa.binary()), ("escapes", pa.binary())]


def _write(batches: Iterator[pa.RecordBatch], *, path: str, end_id: int, block_ids: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of one shard, of block_ids or more ids. They end with documents; one of over four times as many goes on in the next block."""
    encoder, end, shard = library_encoder(path, CACHE_WORDS), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
    block, before = 0, 0
    ids: list[bytes] = []
    docs: list[int | None] = []
    sizes: list[int] = []
    held = 0

    def close() -> pa.RecordBatch:
        nonlocal block, before, ids, docs, sizes, held
        words, escapes = encode_words(np.frombuffer(b"".join(ids), "<u4"))
        row = (
            shard,
            block,
            before,
            held,
            np.array([d or 0 for d in docs], "<i8").tobytes(),
            bytes(d is None for d in docs),
            np.array(sizes, "<i8").tobytes(),
            words.tobytes(),
            escapes.tobytes(),
        )
        block, before, ids, docs, sizes, held = block + 1, before + held, [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = encoder.encode_bytes(text or "") + end
            if held + len(raw) // 4 > 4 * block_ids and held:
                yield close()
            while raw:  # only a document of more than four blocks' ids is cut
                part = raw[: 16 * block_ids]
                raw = raw[len(part) :]
                ids.append(part)
                docs.append(doc_id)
                # A negative size says that the document goes on in the next block.
                sizes.append(-(len(part) // 4) if raw else len(part) // 4)
                held += len(part) // 4
                if held >= block_ids or raw:
                    yield close()
    if held:
        yield close()


#: Characters of a text that ranges are cut by where one doc_id has many rows.
ORDER_CHARS = 64


def write(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 1, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> None:
    """Write the ids of all whole texts as token files under `path`, in ascending doc_id order.

    Ranges of doc_id are the shards, so shard, block and place give the order of the
    whole. Null texts count as empty: they hold the end id alone. Null doc_ids come
    first; equal ones stand next to each other, in the order of their texts (ranges are cut
    by the first ORDER_CHARS characters, so rows alike in these come to one shard).
    """
    spark = docs.sparkSession
    schema, ddl = arrow_schema(BLOCK_FIELDS)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.substring("text", 1, ORDER_CHARS)).sortWithinPartitions("doc_id", "text")
    run = partial(_write, path=tokenizer_path, end_id=end_id, block_ids=block_ids, schema=schema)
    ordered.mapInArrow(run, ddl).write.mode("overwrite").parquet(path)


def _ids_of(words: bytes, escapes: bytes, n: int) -> np.ndarray:
    return decode_words(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8"))[:n].astype("<u4")


def _read(batches: Iterator[pa.RecordBatch], *, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard, block, first, n, doc_ids, nulls, sizes, words, escapes = (batch.column(j)[i].as_py() for j in range(9))
            ids, signed = _ids_of(words, escapes, n), np.frombuffer(sizes, "<i8")
            size = np.abs(signed)
            ends = np.cumsum(size)
            raw = ids.tobytes()
            crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
            of = [None if x else d for d, x in zip(np.frombuffer(doc_ids, "<i8").tolist(), nulls, strict=True)]
            whole = signed > 0
            columns = [of, [shard] * len(of), [block] * len(of), (first + ends - size).tolist(), size.tolist(), crc, whole.tolist(), list(range(len(of)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, shard_start): the ids before each shard. One row for each shard, so a bounded window."""
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    rows = sorted((r.shard, r.n) for r in sums.collect())  # as many rows as the writer had tasks
    out, at = [], 0
    for shard, n in rows:
        out.append((shard, at))
        at += n
    return blocks.sparkSession.createDataFrame(out, "shard int, shard_start bigint")


def _crc_shift(crc: int, n_bytes: int) -> int:
    """The register of crc32 after n zero bytes follow, by squaring the one-bit operator."""
    op = [0xEDB88320] + [1 << i for i in range(31)]  # fixed value: the reflected CRC-32 polynomial
    apply = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    n = 8 * n_bytes
    while n:
        if n & 1:
            crc = apply(op, crc)
        op = [apply(op, x) for x in op]
        n >>= 1
    return crc


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def _join_parts(table: pa.Table) -> pa.Table:
    """Parts of one document, in order: crc32 of the whole from those of the parts."""
    parts = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "n", "crc", "doc_id")), strict=True))
    crc = 0
    for _, n, x, _ in parts:
        crc = _crc_shift(crc, 4 * n) ^ x
    return pa.table({"doc_id": pa.array([parts[0][3]], pa.int64()), "start": pa.array([parts[0][0]], pa.int64()), "n_tokens": pa.array([sum(p[1] for p in parts)], pa.int64()), "ids_crc32": pa.array([crc], pa.int64())})


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the token files under `path`.

    `start` counts all ids before the document in the whole set. Blocks are decoded
    where they lie; only documents that cross a block are put together by a shuffle.
    """
    schema, ddl = arrow_schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("whole", pa.bool_()), ("place", pa.int64())])
    blocks = spark.read.parquet(path)
    starts = shard_starts(blocks.select("shard", "n_ids"))
    parts = materialise(blocks.mapInArrow(partial(_read, schema=schema), ddl), "parts")
    # The last entry of a block goes on in the next block's first one, and so on while a block has a single open entry.
    open_ = parts.where("NOT whole").select("shard", F.col("block").alias("b"))
    follows = open_.select("shard", (F.col("b") + 1).alias("block"), F.lit(0).cast("bigint").alias("place"), F.lit(True).alias("goes_on"))
    marked = parts.join(follows, ["shard", "block", "place"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    starts_here = marked.where("whole AND NOT goes_on").select("doc_id", "shard", F.col("at").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = marked.where("NOT whole OR goes_on")
    chain = Window.partitionBy("shard").orderBy("at")
    cut = cut.withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(chain))
    joined = cut.select("doc_id", "shard", "chain", "at", "n", "crc").groupBy("shard", "chain").applyInArrow(
        _joined_with_shard,
        "doc_id bigint, shard int, start bigint, n_tokens bigint, ids_crc32 bigint",
    )
    return starts_here.unionByName(joined).join(starts, "shard").select("doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def _joined_with_shard(table: pa.Table) -> pa.Table:
    out = _join_parts(table)
    return out.add_column(1, "shard", pa.array([table.column("shard")[0].as_py()], pa.int32()))


def read_ids(spark, path: str) -> DataFrame:
    """(shard, block, first_id, ids array<int>): every block's ids, decoded where it lies."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                s, k, f, n, w, e = (b.column(j)[i].as_py() for j in range(6))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([k], pa.int64()), pa.array([f], pa.int64()), pa.array([_ids_of(w, e, n).tolist()], pa.list_(pa.int64()))],
                    schema=schema,
                )

    return spark.read.parquet(path).select("shard", "block", "first_id", "n_ids", "words", "escapes").mapInArrow(run, "shard int, block bigint, first_id bigint, ids array<bigint>")
