"""The hash chain over the log: building, link checks, content checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import GENESIS, event_digest, event_ref, link
from ..sources import files
from ..sources.shared import folder, materialise


def payloads(log: DataFrame) -> DataFrame:
    """(seq, kind, ref, payload_hash): row-local, so as parallel as the scan."""
    return log.select("seq", F.col("op").alias("kind"), event_ref().alias("ref"), event_digest().alias("payload_hash"))


#: Entries that one task sorts and chains.
PART = 200_000
#: Entries in a row of a part's blocks.
BLOCK = 10_000
_FIELDS = ("seq", "kind", "ref", "payload_hash")
_ENTRY = "seq bigint, kind string, ref string, payload_hash string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a part as blocks: one row of lists for each."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            own = b.slice(lo, BLOCK)
            lists = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), pa.concat_arrays([c])) for c in own.columns]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int32()), *lists], names=["part", "at", *_FIELDS])
            at += 1


def _heads(batches: Iterator[pa.RecordBatch], *, prev: str) -> Iterator[pa.RecordBatch]:
    """The chain's heads before and after each block, blocks in their order."""
    for b in batches:
        before, after = [], []
        for hashes in b.column("payload_hash"):
            before.append(prev)
            for h in hashes.values.to_pylist():
                prev = hashlib.sha256((prev + h).encode()).hexdigest()
            after.append(prev)
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("at"), pa.array(before, pa.string()), pa.array(after, pa.string())], names=["part", "at", "head", "next"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, prev in enumerate(b.column("head").to_pylist()):
            own = [b.column(c)[i].values for c in _FIELDS]
            before, entry = [], []
            for h in own[3].to_pylist():
                before.append(prev)
                prev = hashlib.sha256((prev + h).encode()).hexdigest()
                entry.append(prev)
            yield pa.RecordBatch.from_arrays([*own, pa.array(before, pa.string()), pa.array(entry, pa.string())], names=[*_FIELDS, "prev_hash", "entry_hash"])


def build_from(rows: DataFrame, head: str) -> DataFrame:
    """Entries that go on from a chain's head."""
    return build(rows, head)


def build(rows: DataFrame, head: str = GENESIS) -> DataFrame:
    """Entries of the chain over (seq, kind, ref, payload_hash).

    Rows are written in ranges of seq of about PART rows. Each link needs the one before, so
    small jobs follow one another, each hashing the short hashes of one range from the head
    that the last one left. With the heads known, the entries of all ranges are made at once.
    """
    spark, path = rows.sparkSession, folder(rows.sparkSession)
    rows = rows.select(*_FIELDS)
    n = rows.agg(F.count("*").alias("n")).head().n
    ordered = rows.repartitionByRange(-(-n // PART) or 1, "seq").sortWithinPartitions("seq")
    schema = "at int, seq array<bigint>, kind array<string>, ref array<string>, payload_hash array<string>"
    ordered.mapInArrow(_blocks, f"part int, {schema}").write.partitionBy("part").parquet(path)
    parts = sorted(int(x.removeprefix("part=")) for x in files.names(spark, path, "part=*"))
    heads: list[tuple] = []
    for p in parts:
        own = spark.read.schema(schema).parquet(f"{path}/part={p}").select(F.lit(p).alias("part"), "at", "payload_hash")
        found = own.coalesce(1).sortWithinPartitions("at").mapInArrow(partial(_heads, prev=head), "part int, at int, head string, next string").collect()
        heads += [(r.part, r.at, r.head) for r in found]
        head = found[-1].next
    blocks = spark.read.schema(f"{schema}, part int").parquet(path) if parts else spark.createDataFrame([], f"{schema}, part int")
    known = blocks.join(F.broadcast(spark.createDataFrame(heads, "part int, at int, head string")), ["part", "at"])
    return known.select(*_FIELDS, "head").mapInArrow(_entries, f"{_ENTRY}, prev_hash string, entry_hash string")


def _head_of(hashes):
    return F.aggregate(hashes, F.lit(GENESIS), lambda a, h: link(a, h))


def build_blocks(rows: DataFrame, size: int = 1000) -> DataFrame:
    """(block, head, n): a chain for each `size` entries, in parallel; an option beside the single chain."""
    block = F.floor((F.col("seq") - 1) / size).alias("block")
    g = rows.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("seq", "payload_hash"))).alias("xs"))
    return g.select("block", _head_of(F.transform("xs", lambda x: x["payload_hash"])).alias("head"), F.size("xs").cast("bigint").alias("n"))


def head(entries: DataFrame) -> DataFrame:
    return entries.agg(F.max_by("entry_hash", "seq").alias("head"), F.count("*").alias("entries"))


def verify_links(entries: DataFrame) -> DataFrame:
    """One row: ok, entries, broken_at (the first bad seq), head (the last good entry's hash).

    Neighbours meet by an equi-join on seq - 1 within the order of seq, so no task holds
    the whole chain; a missing predecessor is a break. The first entry follows the genesis.
    """
    entries = materialise(entries.select("seq", "payload_hash", "prev_hash", "entry_hash"))  # read several times
    before = entries.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("was"))
    start = entries.agg(F.min("seq").alias("first_seq"))
    rows = entries.join(before, "seq", "left").join(F.broadcast(start))
    bad = ~(F.col("prev_hash").eqNullSafe(F.when(F.col("seq") == F.col("first_seq"), F.lit(GENESIS)).otherwise(F.col("was"))) & F.col("entry_hash").eqNullSafe(link(F.col("prev_hash"), F.col("payload_hash"))))
    first_bad = materialise(rows.agg(F.min(F.when(bad, F.col("seq"))).alias("broken_at"), F.count("*").alias("entries")))
    good = entries.select("seq", "entry_hash").join(F.broadcast(first_bad)).where("broken_at IS NULL OR seq < broken_at")
    last = good.agg(F.max_by("entry_hash", "seq").alias("head"))
    return first_bad.join(last).select(F.col("broken_at").isNull().alias("ok"), "entries", "broken_at", F.coalesce("head", F.lit(GENESIS)).alias("head"))


def erased_refs(log: DataFrame, keyring: DataFrame) -> DataFrame:
    """Ids of episodes and facts of subjects that have a tombstone and no key."""
    gone = log.where("op = 'subject_forgotten'").select("subject_id").distinct().join(keyring.select("subject_id"), "subject_id", "left_anti")
    rows = log.where("op IN ('episode', 'asserted')").join(gone, "subject_id", "left_semi")
    return rows.select(event_ref().alias("ref")).distinct()


def verify_deep(log: DataFrame, entries: DataFrame, erased: DataFrame | None = None) -> DataFrame:
    """One row: ok, entries, broken_at. Links first; then each entry's event must re-derive its kind, ref and hash.

    An entry whose event cannot be read is right only if its ref was erased for good;
    a readable event without an entry breaks after the last one.
    """
    same = F.sha2("payload", 256).eqNullSafe(F.col("content_hash"))
    d = log.where("seq IS NOT NULL").select(
        "seq",
        F.col("op").alias("k"),
        event_ref().alias("r"),
        event_digest().alias("h"),
        ((F.col("op") != "episode") | F.coalesce(same, F.lit(False))).alias("whole"),
    )
    rows = entries.select("seq", "kind", "ref", "payload_hash", F.lit(True).alias("entered")).join(d, "seq", "full")
    if erased is not None:
        rows = rows.join(erased.select("ref", F.lit(True).alias("was_erased")).distinct(), "ref", "left")
    else:
        rows = rows.withColumn("was_erased", F.lit(None).cast("boolean"))
    match = F.coalesce((F.col("kind") == F.col("k")) & (F.col("ref") == F.col("r")) & (F.col("payload_hash") == F.col("h")) & F.col("whole"), F.lit(False))
    excused = F.col("k").isNull() & F.coalesce("was_erased", F.lit(False))
    bad = F.col("entered") & ~match & ~excused
    sums = rows.agg(F.min(F.when(bad, F.col("seq"))).alias("bad_seq"), F.count("entered").alias("entries"), F.count_if(F.col("entered").isNull()).alias("unvouched"))
    links = verify_links(entries).select(F.col("broken_at").alias("link_seq"))
    at = F.coalesce("link_seq", "bad_seq", F.when(F.col("unvouched") > 0, F.col("entries") + 1))
    return sums.join(links).select(at.isNull().alias("ok"), "entries", at.alias("broken_at"))
