"""SimHash fingerprints and their near-duplicate groups by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise
from .components import components

#: Bits of a fingerprint in three bands: two differing bits leave one band untouched.
BANDS = ((0, 22), (22, 21), (43, 21))
BUDGET = 2
#: A band's value with more fingerprints is dealt over the values of three parts of its other bits.
HOT_BAND = 16_384
#: Node pairs that are expanded at once.
FRONTIER = 1 << 20
_AT_ONCE = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half of the XXH64 values (seed 42) of the word shingles, repeats included.

    A-Z are lower-cased, words are parted by ASCII white space; a text of fewer words
    is one shingle, one without words (or null) has fingerprint zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    n, counts, digest = len(parts) - words + 1, np.zeros(64, np.int64), xxhash.xxh64_digest
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    done = 0
    while done < n:
        size = min(_AT_ONCE, n - done)
        raw = b"".join([digest(x, 42) for x, _ in zip(shingles, range(size), strict=False)]) if size == n else b"".join([digest(next(shingles), 42) for _ in range(size)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(size, 8), axis=1).sum(0, dtype=np.int64)
        done += size
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(doc_id: pa.Array, text: pa.Array, words: int):
    # Spark's long is signed: the same 64 bits.
    texts = text.to_pylist()
    keys = np.array([xxhash.xxh64_intdigest((x or "").encode("utf-8", "surrogatepass"), 42) for x in texts], np.uint64)
    return doc_id, keys.view(np.int64), np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_key, fp): one row for each row, fp the 64 bits as a long, text_key the XXH64 of the text."""
    return map_rows(docs.select("doc_id", "text"), partial(_fingerprints, words=words), [("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_pairs(keys: np.ndarray, exact: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted distinct 64-bit keys that agree in the first `exact` bits and differ in at most `budget` others.

    A trie node is a range of keys. Pairs of nodes go down together, level by level:
    equal children keep their differing bits, unequal ones add one, and a pair over the
    budget is cut off with all below. A wide frontier is cut in parts, so memory stays bounded.
    """
    n = len(keys)
    if n < 2:
        return
    prefix = keys >> np.uint64(64 - exact) if exact else np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
    ends = np.append(starts[1:], n)
    several = ends - starts > 1
    lo, hi = starts[several], ends[several]
    stack = [(exact, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, alo, ahi, blo, bhi, bits = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            mid = len(alo) // 2
            stack += [(depth, *(x[:mid] for x in (alo, ahi, blo, bhi, bits))), (depth, *(x[mid:] for x in (alo, ahi, blo, bhi, bits)))]
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            i, j = alo[single], blo[single]
            near = (i != j) & (_popcount(keys[i] ^ keys[j]) <= budget)
            if near.any():
                yield np.minimum(i[near], j[near]), np.maximum(i[near], j[near])
            alo, ahi, blo, bhi, bits = (x[~single] for x in (alo, ahi, blo, bhi, bits))
            if not len(alo):
                continue
        if depth == 64:
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        c = ones[depth]
        amid, bmid, own = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo]), alo == blo
        down = [(alo, amid, blo, bmid, bits, None), (amid, ahi, bmid, bhi, bits, None), (alo, amid, bmid, bhi, bits + 1, None), (amid, ahi, blo, bmid, bits + 1, ~own)]
        kept = []
        for a0, a1, b0, b1, e, more in down:
            ok = (a1 > a0) & (b1 > b0) & (e <= budget)
            if more is not None:
                ok &= more
            ok &= ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))
            kept.append([x[ok] for x in (a0, a1, b0, b1, e)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index reachable, by hooking and pointer jumping over one batch of pairs after the other."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def _parts_of_rest(width: int) -> list[tuple[int, int]]:
    """(start, bits) of three parts of the bits that a band of `width` bits leaves."""
    cuts = np.linspace(width, 64, 4).astype(int).tolist()
    return list(zip(cuts[:-1], np.diff(cuts).tolist(), strict=True))


def _turned(fp: np.ndarray, band: int, part: int) -> tuple[np.ndarray, int]:
    """Fingerprints with the bits that are equal in the task's group in front, and the number of those bits."""
    at, width = BANDS[band]
    x = (fp << np.uint64(at)) | (fp >> np.uint64(64 - at)) if at else fp
    if part < 0:
        return x, width
    start, bits = _parts_of_rest(width)[part]
    rest, by = 64 - width, start - width
    mask = np.uint64((1 << rest) - 1)
    low = x & mask
    moved = ((low << np.uint64(by)) | (low >> np.uint64(rest - by))) & mask if by else low
    return (x & ~mask) | moved, width + bits


def _links(batches: Iterator[pa.RecordBatch], *, budget: int) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        band, part, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
        for b, q in np.unique(np.stack([band, part], 1), axis=0).tolist():
            held.setdefault((b, q), []).append(fp[(band == b) & (part == q)])
    for (b, q), parts in held.items():
        fp = np.unique(np.concatenate(parts))
        turned, exact = _turned(fp, b, q)
        order = np.argsort(turned)
        keys, fp = turned[order], fp[order]
        root = _roots(len(keys), trie_pairs(keys, exact, budget))
        linked = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))], names=["u", "v"])


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v) between distinct fingerprints `fp`: for each group a forest of the pairs within the budget.

    At most two differing bits leave one of the three bands equal, so every pair meets
    in the task of that band's value; pairs reduce there to the links that join them.
    A value with more than HOT_BAND fingerprints is split: of three parts of its other
    bits one is equal too, so the pair meets in the group of that part's value.
    """
    turn = lambda at: F.expr(f"shiftleft(fp, {at}) | shiftrightunsigned(fp, {64 - at})") if at else F.col("fp")
    turned = [F.struct(F.lit(b).alias("band"), turn(at).alias("x"), F.shiftrightunsigned(turn(at), 64 - width).alias("key")) for b, (at, width) in enumerate(BANDS)]
    rows = distinct.select("fp", F.explode(F.array(*turned)).alias("y")).select("fp", "y.band", "y.x", "y.key")
    full = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BAND).select("band", "key", F.lit(True).alias("hot"))
    # Written, so that the join has an exchange on both sides and a hot value can be split.
    dealt = rows.join(materialise(full, "hot-bands"), ["band", "key"], "left")
    group = lambda part, value: F.struct(F.lit(part).alias("part"), value.cast("bigint").alias("value"))
    split = F.lit(None)
    for b, (_, width) in enumerate(BANDS):
        own = F.array(*[group(i, F.shiftrightunsigned(F.shiftleft("x", start), 64 - bits)) for i, (start, bits) in enumerate(_parts_of_rest(width))])
        split = F.when(F.col("band") == b, own).otherwise(split)
    groups = F.when(F.col("hot"), split).otherwise(F.array(group(-1, F.lit(0))))
    dealt = dealt.select("band", "key", "fp", F.explode(groups).alias("g")).select("band", "key", "g.part", "g.value", "fp")
    return dealt.repartition("band", "key", "part", "value").select("band", "part", "fp").mapInArrow(partial(_links, budget=budget), "u bigint, v bigint")


def near_groups(docs: DataFrame, words: int = 3, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Fingerprints within `budget` bits are linked; component_id is the smallest doc_id
    that links reach. Texts without words all have fingerprint zero, linked like any
    other. Repeated rows repeat; null doc_ids are null and never the smallest; an empty
    table gives no row. Equal fingerprints are one node: copies cost no pairs.
    """
    fps = materialise(fingerprints(docs, words), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = components(links(nodes.select("fp"), budget))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")


def deduplicate(docs: DataFrame, words: int = 3, budget: int = BUDGET) -> DataFrame:
    """docs with one row of each near-duplicate group, that of the smallest doc_id; all columns stay.

    Rows with that doc_id and the same text count as one; a group whose ids are all null keeps its distinct texts.
    """
    key = lambda doc_id, text_key: F.concat_ws("/", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), text_key.cast("string"))
    stay = near_groups(docs, words, budget).where("doc_id <=> component_id").select(key("doc_id", F.col("text_key")).alias("__key")).distinct()
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("__key", key("doc_id", own)).join(stay, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
