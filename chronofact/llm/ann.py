"""Nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

The quantisers are fitted on a bounded sample and broadcast (their size is set by
parameters, not by the data); every vector is indexed. The index is dealt out by list
once; the queries come to it in broadcast blocks of bounded size, each with a bit for
every list that it reads, and nothing of the index is copied or moved for them. A
list's rows are compared by asymmetric distance tables. The length of what a code
leaves out is kept with it, so a table bounds the true distance: every row that can be
among the k nearest is ranked by its exact cosine on the original vector, and no list
that is read loses a neighbour, however many lie close together.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_until_end, materialise, shared_dir
from .toxicity import _Held

#: Vectors that the quantisers are fitted on, at most; those with the smallest hashes of their ids.
SAMPLE = 20_000
LIST_SIZE, MAX_LISTS, WORDS = 100, 4_096, 256
#: Rows of one list that a task takes at once, and the most pairs of them and queries.
BLOCK, PAIRS = 4_096, 1 << 20
#: Bytes of queries that are broadcast at once.
QUERY_BYTES = 16 << 20
#: A query reads so many vectors at least.
LEAST = 8_192
#: Rounding of squared distances and cosines of unit vectors.
SLACK = 1e-11


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, norm) without vectors that are null, zero, or hold null or non-finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    top = F.array_max(F.transform("v", F.abs))  # scaled, so that the squares neither overflow nor vanish
    norm = top * F.sqrt(F.aggregate(F.transform("v", lambda x: x / top), F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.where(F.coalesce(finite & (F.size("v") > 0), F.lit(False))).where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("norm", norm)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()), replace=False)]
    return c


def fit(sample: np.ndarray, lists: int, parts: int) -> dict:
    """Coarse centroids of unit vectors, and for each part of the residual a codebook."""
    rng = np.random.default_rng(7)
    coarse = _kmeans(sample, lists, rng)
    rest = sample - coarse[_nearest(sample, coarse)]
    cuts = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
    return {"coarse": coarse, "cuts": cuts, "books": [_kmeans(rest[:, a:b], WORDS, rng) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]}


def _matrix(v: pa.Array, norm: pa.Array) -> np.ndarray:
    return np.stack(v.to_numpy(zero_copy_only=False)) / norm.to_numpy()[:, None]


def _fit_rows(batches: Iterator[pa.RecordBatch], *, lists: int, parts: int) -> Iterator[pa.RecordBatch]:
    rows = [_matrix(b.column("v"), b.column("norm")) for b in batches if b.num_rows]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(np.concatenate(rows), lists, parts))], pa.binary())], names=["model"])


_models: dict[int, dict] = {}


def _model(held) -> dict:
    if held.id not in _models:
        _models.clear()
        _models[held.id] = pickle.loads(held.value)
    return _models[held.id]


def _pack(v: np.ndarray) -> list[bytes]:
    """The components of each row, in four bytes each where that loses nothing."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return [(x if same else y).tobytes() for x, y, same in zip(short, v.astype("<f8"), (short == v).all(1), strict=True)]


def _unpack(raw: list[bytes], d: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * d else "<f8") for x in raw]).astype(float)


def _encode(batches: Iterator[pa.RecordBatch], *, held) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            m, x = _model(held), _matrix(b.column("v"), b.column("norm"))
            own = _nearest(x, m["coarse"])
            rest = x - m["coarse"][own]
            codes = np.stack([_nearest(rest[:, a:z], book) for a, z, book in zip(m["cuts"][:-1], m["cuts"][1:], m["books"], strict=True)], 1).astype(np.uint8)
            error = np.sqrt(sum(((rest[:, a:z] - book[codes[:, j]]) ** 2).sum(1) for j, (a, z, book) in enumerate(zip(m["cuts"][:-1], m["cuts"][1:], m["books"], strict=True))))
            raw = _pack(np.stack(b.column("v").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), b.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(raw, pa.binary()), b.column("norm")],
                names=["list_id", "vec_id", "code", "error", "raw", "norm"],
            )


def _probe(batches: Iterator[pa.RecordBatch], *, held, sizes, probes: int, least: int) -> Iterator[pa.RecordBatch]:
    """A bit for each list that a query reads: the nearest `probes`, and more until they hold `least` vectors."""
    n = sizes.value
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            b = batch.slice(lo, 1024)
            m, x = _model(held), _matrix(b.column("v"), b.column("norm"))
            order = np.argsort((m["coarse"] ** 2).sum(1) - 2 * x @ m["coarse"].T, axis=1, kind="stable")
            take = np.maximum(probes, (np.cumsum(n[order], 1) < least).sum(1) + 1)
            reads = np.zeros(order.shape, bool)
            np.put_along_axis(reads, order, np.arange(order.shape[1])[None] < take[:, None], 1)
            raw = _pack(np.stack(b.column("v").to_numpy(zero_copy_only=False)))
            bits = [r.tobytes() for r in np.packbits(reads, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(raw, pa.binary()), b.column("norm"), pa.array(bits, pa.binary())],
                names=["query_id", "raw", "norm", "reads"],
            )


class _Best:
    """The k nearest rows so far of each query of a block."""

    def __init__(self, queries: dict, model: dict, k: int):
        self.model, self.k = model, k
        self.ids, self.norm, self.reads = queries["ids"], queries["norm"], queries["reads"]
        self.q = _unpack(queries["raw"], model["coarse"].shape[1])
        self.unit = self.q / self.norm[:, None]
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: Squared distance of the k-th nearest unit vector so far.
        self.reach = np.full(len(self.ids), np.inf)

    def scan(self, list_id: int, ids: np.ndarray, codes: np.ndarray, error: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        """Take in rows of one list for the queries that read it."""
        asked = np.flatnonzero(self.reads[:, list_id >> 3] >> (7 - list_id % 8) & 1)
        columns, unit, step = np.ascontiguousarray(v.T), v / norm[:, None], max(1, PAIRS // len(ids))
        for lo in range(0, len(asked), step):
            own = asked[lo : lo + step]
            self._merge(*self._candidates(own, self.model["coarse"][list_id], ids, codes, error, unit), ids, columns, unit, norm)

    def _candidates(self, own: np.ndarray, centre: np.ndarray, ids: np.ndarray, codes: np.ndarray, error: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that the tables do not rule out.

        A table is off by the row's `error` at most. The k-th exact distance of the rows
        nearest by it bounds the k-th of all; only what is certainly beyond is left out.
        """
        m = self.model
        rest, squares = self.unit[own] - centre, np.zeros((len(own), len(ids)))
        for j, (a, z, book) in enumerate(zip(m["cuts"][:-1], m["cuts"][1:], m["books"], strict=True)):
            part = rest[:, a:z]
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            squares += table[:, codes[:, j]]
        distance = np.sqrt(np.maximum(squares, 0))
        itself = ids[None] == self.ids[own][:, None]
        distance[itself] = np.inf
        reach = self.reach[own]
        if len(ids) > self.k + 1:
            first = np.argpartition(distance, self.k - 1, axis=1)[:, : self.k]
            exact = ((unit[first] - self.unit[own][:, None]) ** 2).sum(2)
            reach = np.minimum(reach, np.where(np.isfinite(np.take_along_axis(distance, first, 1)).all(1), exact.max(1), np.inf))
        near = (np.maximum(distance - error, 0) ** 2 <= reach[:, None] + SLACK) & ~itself
        at, row = np.nonzero(near)
        return own[at], row

    def _merge(self, at: np.ndarray, row: np.ndarray, ids: np.ndarray, columns: np.ndarray, unit: np.ndarray, norm: np.ndarray) -> None:
        """Rank the pairs by exact cosine among what was found before; ties go to the smaller id."""
        if not len(at):
            return
        dot = np.zeros(len(at))  # in the order of components, so that equal vectors have equal scores
        for x, y in zip(columns, self.q.T, strict=True):
            dot += x[row] * y[at]
        with np.errstate(all="ignore"):
            score = dot / (norm[row] * self.norm[at])
        if (odd := np.flatnonzero(~np.isfinite(score))).size:
            score[odd] = (unit[row[odd]] * self.unit[at[odd]]).sum(1)
        touched = np.zeros(len(self.ids), bool)
        touched[at] = True
        old = touched[self.query]
        q, r, s = np.concatenate([at, self.query[old]]), np.concatenate([ids[row], self.row[old]]), np.concatenate([score, self.score[old]])
        by = np.lexsort((r, -s, q))
        q, r, s = q[by], r[by], s[by]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        full = place == self.k - 1
        self.reach[q[full]] = np.maximum(2 - 2 * s[full], 0) + SLACK
        kept = place < self.k
        self.query, self.row, self.score = (np.concatenate([x[~old], y[kept]]) for x, y in ((self.query, q), (self.row, r), (self.score, s)))


def _scan(batches: Iterator[pa.RecordBatch], *, held, asked, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of this task for each query of the block."""
    best = None
    for b in batches:
        if not b.num_rows:
            continue
        best = best or _Best(asked.value, _model(held), k)
        order = np.argsort(lists := b.column("list_id").to_numpy(), kind="stable")
        d = best.q.shape[1]
        for part in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
            for lo in range(0, len(part), BLOCK):
                x = b.take(pa.array(part[lo : lo + BLOCK]))
                codes = np.frombuffer(b"".join(x.column("code").to_pylist()), np.uint8).reshape(x.num_rows, -1)
                ids, error, norm = (x.column(c).to_numpy() for c in ("vec_id", "error", "norm"))
                best.scan(int(x.column("list_id")[0].as_py()), ids, codes, error, _unpack(x.column("raw").to_pylist(), d), norm)
    if best is not None:
        yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.query]), pa.array(best.row), pa.array(best.score)], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries, *, k: int = 5, parts: int = 16, probes: float = 0.4, list_size: int = LIST_SIZE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by cosine of the rows where `queries` holds, against all others.

    Vectors that are null, zero, or hold null or non-finite components take no part; of
    different dimensions the most frequent counts (ties: the smaller). Of rows with one
    vec_id the one with the least vector (by its components in order) is taken; a vec_id is
    never its own neighbour. There is a list for about `list_size` vectors, MAX_LISTS at
    most; `probes` is the share of the lists that a query reads, more where they hold less
    than `least` vectors; of the lists that it reads the result is exact. A list's rows are
    dealt out in blocks, so a list with a third of all rows is many tasks. Too few rows give
    fewer neighbours; no usable row gives no result.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors), "vectors")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == dims.d)
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        n = dims["count"]
    else:
        first = F.min(F.struct("v", "norm"))
        rows = materialise(rows.groupBy("vec_id").agg(first.alias("x")).select("vec_id", "x.v", "x.norm"), "one-of-each-id")
        n = rows.count()
    lists = max(1, min(MAX_LISTS, n // list_size))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).repartition(1).sortWithinPartitions("vec_id")
    fitted = sample.mapInArrow(partial(_fit_rows, lists=lists, parts=parts), "model binary").collect()
    held = _Held(spark, bytes(fitted[0].model))
    coded = materialise(rows.mapInArrow(partial(_encode, held=held), "list_id int, vec_id bigint, code binary, error double, raw binary, norm double"), "coded")
    # One number for each list, at most MAX_LISTS.
    size_of = {r.list_id: r["count"] for r in coded.groupBy("list_id").count().collect()}
    sizes = spark.sparkContext.broadcast(np.array([size_of.get(i, 0) for i in range(max(lists, max(size_of) + 1))]))
    block = F.pmod(F.hash("vec_id"), F.greatest(F.lit(1), F.ceil(F.element_at(F.lit(sizes.value.tolist()), F.col("list_id") + 1) / BLOCK)).cast("int"))
    index = materialise(coded.repartition("list_id", block).sortWithinPartitions("list_id"), "index")
    asked = rows.where(queries)
    probed = asked.mapInArrow(partial(_probe, held=held, sizes=sizes, probes=max(1, round(lists * probes)), least=least), "query_id bigint, raw binary, norm double, reads binary")
    blocks = max(1, -(-asked.count() * (8 * dims.d + lists // 8) // QUERY_BYTES))
    probed = materialise(probed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    path = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    keep_until_end(spark, path)
    for i in range(blocks):
        own = probed.where(F.col("block") == i).toArrow()  # about QUERY_BYTES
        if own.num_rows:
            sent = {"ids": own.column("query_id").to_numpy(), "raw": own.column("raw").to_pylist(), "norm": own.column("norm").to_numpy(), "reads": np.stack([np.frombuffer(x, np.uint8) for x in own.column("reads").to_pylist()])}
            found = index.mapInArrow(partial(_scan, held=held, asked=spark.sparkContext.broadcast(sent), k=k), "query_id bigint, vec_id bigint, score double")
            found.write.mode("append").parquet(path)
        elif i == blocks - 1:
            spark.createDataFrame([], "query_id bigint, vec_id bigint, score double").write.mode("append").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema("query_id bigint, vec_id bigint, score double").parquet(path).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
