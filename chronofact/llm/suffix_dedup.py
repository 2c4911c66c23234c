"""Removal of repeated byte strings by external induced suffix sorting.

Only text that can repeat is sorted. Every string of `width` bytes has one anchor, the
place of the least hash of its `GRAM`-byte strings; equal strings have equal anchors at
the same offset. An anchor whose hash occurs once in the corpus therefore belongs to
no repeated string. What is around the other anchors (a stretch: all strings of the
anchor) goes to the shard of its hash, equal stretches as one with a count. A shard
sorts the suffixes of its different stretches; places with a common prefix of `width`
bytes are neighbours then. A stretch counted twice or more is repeated as a whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .suffix_sort import prefix_values, repeated_starts

WIDTH, GRAM = 400, 64
_BASE = 0x9E3779B97F4A7C15
#: Bytes of texts that are hashed at once; places take 24 bits beside 40 bits of hash.
_AT_ONCE = 1 << 20
#: Bytes of stretches that a shard takes at once: whole anchors together; one anchor may exceed it and spills.
SORT_BYTES = 8 << 20
#: An anchor with more different stretches than this is no task's: its strings are counted by their bytes, dealt over all tasks.
HOT_STRETCHES = 2_500
#: Neighbouring strings that are first counted by their common bytes, and stretches that are worked on at once.
STEP, _ROWS = 16, 200


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by running minima of blocks from both ends."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, hash, first, last): for each anchor the strings from `first` to `last` that it belongs to, by their starts."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    if not len(texts) or int(size.sum()) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sums, inverse = prefix_values(raw, _BASE)
    n = len(raw) - gram + 1
    grams = _mix((sums[gram:] - sums[:n]) * inverse[:n])
    keyed = (grams & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    at = (_least(keyed, width - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), size)[: len(at)]
    inside = np.arange(len(at)) + width <= (start + size)[text]
    places = np.flatnonzero(inside)
    if not len(places):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    own, of = at[places], text[places]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(places)) - 1
    of = of[head]
    return of, grams[own[head]].view(np.int64), places[head] - start[of], places[tail] - start[of]


def _key(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, 42) - (1 << 64 if xxhash.xxh64_intdigest(raw, 42) >> 63 else 0)


_ANCHOR = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("h", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch], *, width: int, at_once: int | None = None) -> Iterator[pa.RecordBatch]:
    at_once = at_once or _AT_ONCE

    def flush(ids, texts):
        of, h, first, last = anchors(texts, width)
        keys = np.array([_key(t) for t in texts], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(of)), pa.array(keys[of]), pa.array(h), pa.array(first), pa.array(last)], schema=_ANCHOR)

    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if len(raw) < width:
                continue
            if len(raw) > at_once:  # a very long text in parts that share width - 1 bytes: each string lies in one of them
                for lo in range(0, len(raw) - width + 1, at_once - width + 1):
                    part = raw[lo : lo + at_once]
                    _, h, first, last = anchors([part], width)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, _key(raw))), pa.array(h), pa.array(first + lo), pa.array(last + lo)],
                        schema=_ANCHOR,
                    )
                continue
            if held + len(raw) > at_once:
                yield flush(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(doc_id)
            texts.append(raw)
            held += len(raw)
        if texts:
            yield flush(ids, texts)


_STRETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("h", pa.int64()), ("sh", pa.binary()), ("first", pa.int64()), ("stretch", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], *, width: int, known: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The stretch of each anchor; its bytes only where this task has not just sent the same."""
    seen: set[bytes] = set()
    for batch in batches:
        for i in range(batch.num_rows):
            doc_id, text_key, text, found = (batch.column(j)[i].as_py() for j in range(4))
            raw, rows = text.encode("utf-8", "surrogatepass"), []
            for x in found:
                part = raw[x["first"] : x["last"] + width]
                sh = hashlib.blake2b(part, digest_size=16).digest()
                rows.append((doc_id, text_key, x["h"], sh, x["first"], None if sh in seen else part))
                seen.add(sh)
            if len(seen) > known:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STRETCH.types, strict=True)], schema=_STRETCH)


_FOUND = pa.schema([("h", pa.int64()), ("sh", pa.binary()), ("spans", pa.list_(pa.int64()))])


def _runs(again: np.ndarray, width: int) -> list[int]:
    """Begin and end, in turn, of what the repeated strings cover."""
    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) + width - 1], 1).ravel().tolist()


def _anchor_in(stretch: bytes, gram: int = GRAM) -> int:
    sums, inverse = prefix_values(np.frombuffer(stretch, np.uint8), _BASE)
    n = len(stretch) - gram + 1
    return int((_mix((sums[gram:] - sums[:n]) * inverse[:n]) & ~np.uint64(0xFFFFFF)).argmin())


def _blocks(sizes: np.ndarray, anchor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, block): the blocks of STEP strings, counted from the anchor, that each stretch has a string of."""
    first, last = -anchor // STEP, (sizes - width - anchor) // STEP
    n = last - first + 1
    of = np.repeat(np.arange(len(sizes)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def _alike(stretches: list[bytes], width: int, gram: int = GRAM) -> list[tuple[int, int]]:
    """The part of each stretch that can share a string with another one, as begin and end; (0, 0) for none."""
    sizes = np.array([len(x) for x in stretches])
    start = np.cumsum(sizes) - sizes
    sums, inverse = prefix_values(np.frombuffer(b"".join(stretches), np.uint8), _BASE)
    n = len(sums) - gram
    grams = _mix((sums[gram:] - sums[:n]) * inverse[:n]) & ~np.uint64(0xFFFFFF)
    anchor = np.array([int(grams[lo : lo + size - gram + 1].argmin()) for lo, size in zip(start.tolist(), sizes.tolist(), strict=True)])
    of, block = _blocks(sizes, anchor, width)
    at = start[of] + anchor[of] + STEP * block + STEP - 1
    value = _mix((sums[at + width - STEP + 1] - sums[at]) * inverse[at] + block.astype(np.uint64))
    _, same, times = np.unique(value, return_inverse=True, return_counts=True)
    again = times[same] > 1
    of, block = of[again], block[again]
    out = [(0, 0)] * len(stretches)
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, int)
    for i, a, b in zip(of[head].tolist(), block[head].tolist(), block[np.append(head[1:], len(of)) - 1].tolist(), strict=True):
        out[i] = (max(0, int(anchor[i]) + STEP * a), min(int(sizes[i]), int(anchor[i]) + STEP * b + STEP - 1 + width))
    return out


def _sort(batches: Iterator[pa.RecordBatch], *, width: int, at_once: int = SORT_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h: what the different stretches of anchors share is found by suffix sorting, many anchors together."""
    held: list[tuple] = []
    group: list[tuple] = []
    size = 0

    def close():
        nonlocal held, size
        parts = [x[3][a:b] for x, (a, b) in zip(held, bounds, strict=True)] if (bounds := _alike([x[3] for x in held], width)) else []
        times = Counter(parts)
        different = [x for x in times if x]
        known = dict(zip(different, repeated_starts(different, width) if different else [], strict=True))
        out = []
        for (h, sh, n, _), (lo, _), part in zip(held, bounds, parts, strict=True):
            if n == 1 and part and (again := known[part] | (times[part] > 1)).any():
                out.append((h, sh, [lo + x for x in _runs(again, width)]))
        held, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FOUND.types, strict=True)], schema=_FOUND)

    def end_group():
        nonlocal group, size
        if len(group) > 1:
            held.extend(group)
            size += sum(len(x[3]) for x in group)
        group = []

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[0] != group[0][0]:
                end_group()
                if size >= at_once:
                    yield from close()
            group.append(row)
    end_group()
    if held:
        yield from close()


_VALUE = pa.schema([("h", pa.int64()), ("sh", pa.binary()), ("anchor", pa.int64()), ("block", pa.int64()), ("v", pa.int64())])
_VALUE_DDL = "h bigint, sh binary, anchor bigint, block bigint, v bigint"


def _cores(batches: Iterator[pa.RecordBatch], *, width: int) -> Iterator[pa.RecordBatch]:
    """A value of the common bytes of each block of STEP neighbouring strings; blocks are counted from the anchor."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            raw = part.column(3).to_pylist()
            sizes, anchor = np.array([len(x) for x in raw]), np.array([_anchor_in(x) for x in raw])
            of, block = _blocks(sizes, anchor, width)
            sums, inverse = prefix_values(np.frombuffer(b"".join(raw), np.uint8), _BASE)
            at = (np.cumsum(sizes) - sizes + anchor)[of] + STEP * block + STEP - 1
            value = ((sums[at + width - STEP + 1] - sums[at]) * inverse[at]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(j).take(pa.array(of)) for j in range(2)), pa.array(anchor[of]), pa.array(block), pa.array(value)], schema=_VALUE)


_BLOCK = pa.schema([("h", pa.int64()), ("sh", pa.binary()), ("n", pa.int64()), ("block", pa.int64()), ("v", pa.int64()), ("core", pa.binary()), ("begin", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])


def _bytes_of(batches: Iterator[pa.RecordBatch], *, width: int) -> Iterator[pa.RecordBatch]:
    """The bytes of blocks: common to their strings, before and after these; strings start at begin + lo to begin + hi."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            rows = []
            for h, sh, n, x, anchor, blocks in zip(*(c.to_pylist() for c in batch.slice(lo, _ROWS).columns), strict=True):
                for b in blocks:
                    s = anchor + STEP * b["block"]
                    first, last = max(0, s), min(len(x) - width, s + STEP - 1)
                    rows.append((h, sh, n, b["block"], b["v"], x[s + STEP - 1 : s + width], s, first - s, last - s, x[first : s + STEP - 1], x[s + width : last + width]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOCK.types, strict=True)], schema=_BLOCK)


def _covered(batches: Iterator[pa.RecordBatch], *, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for found in batch.column(2).to_pylist():
            again = np.zeros(max(found) + 1, bool)
            again[found] = True
            spans.append(_runs(again, width))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64()))], schema=_FOUND)


def _hot_spans(stretches: DataFrame, width: int) -> DataFrame:
    """Spans of (h, sh, n, stretch) by the bytes of strings, so that no anchor is one task's.

    Equal strings lie at the same place relative to their anchor. Blocks of STEP strings
    whose common bytes have a value that recurs are looked at: these bytes are compared with
    those of one block of the value, and the strings of equal ones told apart by the STEP - 1
    bytes that are left of each.
    """
    stretches = materialise(stretches, "hot-stretches")
    cores = materialise(stretches.mapInArrow(partial(_cores, width=width), _VALUE_DDL), "hot-cores")
    again = materialise(cores.groupBy("block", "v").agg(F.count("*").alias("times")).where("times > 1").drop("times"), "hot-recurring")
    live = cores.join(again, ["block", "v"]).groupBy("h", "sh").agg(F.first("anchor").alias("anchor"), F.collect_list(F.struct("block", "v")).alias("blocks"))
    left = stretches.join(live, ["h", "sh"]).select("h", "sh", "n", "stretch", "anchor", "blocks")
    ddl = "h bigint, sh binary, n bigint, block bigint, v bigint, core binary, begin bigint, lo bigint, hi bigint, before binary, after binary"
    blocks = materialise(left.mapInArrow(partial(_bytes_of, width=width), ddl), "hot-blocks")
    one = materialise(blocks.groupBy("block", "v").agg(F.min("core").alias("one")), "hot-one-of-each")
    # Other bytes of the same value, if there are any, are part of the key themselves.
    own = blocks.join(one, ["block", "v"]).withColumn("other", F.when(F.col("core") != F.col("one"), F.col("core")).otherwise(F.lit(b"")))
    rest = F.expr(f"concat(substring(before, cast(o - lo + 1 as int), cast({STEP - 1} - o as int)), substring(after, 1, cast(o as int)))")
    strings = own.withColumn("o", F.explode(F.sequence("lo", "hi"))).select(
        "h",
        "sh",
        "n",
        "block",
        "v",
        "other",
        "o",
        rest.alias("rest"),
        (F.col("begin") + F.col("o")).alias("at"),
    )
    strings = materialise(strings, "hot-strings")
    key = ["block", "v", "other", "o", "rest"]
    again = materialise(strings.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1").drop("times"), "hot-again")
    found = strings.where("n = 1").join(again, key).groupBy("h", "sh").agg(F.collect_list("at").alias("at"))
    return found.select("h", "sh", "at").mapInArrow(partial(_covered, width=width), "h bigint, sh binary, spans array<bigint>")


_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _remove(batches: Iterator[pa.RecordBatch], *, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for x in sorted(pieces or [], key=lambda x: x["first"]):
                for a, b in zip(x["spans"][::2], x["spans"][1::2], strict=True):
                    spans.append([x["first"] + a, x["first"] + b])
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept, at = [], 0
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            rest = b"".join([*kept, raw[at:]])
            out.append((doc_id, rest if with_text else None, len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False, *, at_once: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of each row.

    Each byte covered by a string of `width` bytes that starts at two places or more, of
    any rows, is removed; strings are judged on the input. Null texts are empty; a
    repeated row repeats every string of it; an empty table gives no row. Removed bytes
    may cut a character, so what is kept is binary. The strings of an anchor with over
    HOT_STRETCHES different stretches are counted by their bytes over all tasks instead of
    sorted in one. Texts are hashed by `at_once` bytes, longer ones in overlapping parts.
    """
    rows = docs.select("doc_id", "text")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = materialise(
        rows.where(F.octet_length("text") >= width).mapInArrow(partial(_find, width=width, at_once=at_once), "doc_id bigint, text_key bigint, h bigint, first bigint, last bigint"),
        "anchors",
    )
    # Written, so that the join has an exchange on both sides and a hot hash can be split.
    several = materialise(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "several")
    of_doc = found.join(several, "h").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("h", "first", "last")).alias("found"))
    of_doc = of_doc.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "found")
    texts = rows.where(F.octet_length("text") >= width).withColumn("text_key", key).join(of_doc, F.expr("text_key = k AND doc_id <=> d")).select("doc_id", "text_key", "text", "found")
    stretches = materialise(texts.mapInArrow(partial(_cut, width=width), "doc_id bigint, text_key bigint, h bigint, sh binary, first bigint, stretch binary"), "stretches")
    distinct = stretches.groupBy("h", "sh").agg(F.count("*").alias("n"), F.first("stretch", ignorenulls=True).alias("stretch"))
    distinct = materialise(distinct, "distinct")
    hot = materialise(distinct.groupBy("h").agg(F.count("*").alias("different")).where(F.col("different") > HOT_STRETCHES).select("h"), "hot-anchors")
    any_hot = not hot.isEmpty()  # else the joins would only shuffle
    cold = distinct.join(hot, "h", "left_anti") if any_hot else distinct
    sorted_ = cold.repartition("h").sortWithinPartitions("h", "sh").select("h", "sh", "n", "stretch")
    partly = sorted_.mapInArrow(partial(_sort, width=width), "h bigint, sh binary, spans array<bigint>")
    whole = distinct.where("n > 1").select("h", "sh", F.array(F.lit(0).cast("bigint"), F.octet_length("stretch").cast("bigint")).alias("spans"))
    spans = whole.unionByName(partly)
    if any_hot:
        spans = spans.unionByName(_hot_spans(distinct.join(hot, "h", "left_semi").select("h", "sh", "n", "stretch"), width))
    pieces = stretches.select("doc_id", "text_key", "h", "sh", "first").join(spans, ["h", "sh"]).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "spans")).alias("pieces"))
    pieces = pieces.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "pieces")
    out = rows.withColumn("text_key", key).join(pieces, F.expr("text_key = k AND doc_id <=> d"), "left").select("doc_id", "text", "pieces")
    done = out.mapInArrow(partial(_remove, with_text=with_text), "doc_id bigint, text binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return done.withColumnRenamed("text", "kept") if with_text else done.drop("text")
