"""Ranking of edges for a question: vector similarity blended with keyword overlap."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edge_text, overlap, token_set
from ..functions.vector import cosine, dot, vectors

# Fixed values: (semantic, keyword) weights for a model's vectors and for hashed ones.
WEIGHTS = {True: (0.7, 0.3), False: (0.4, 0.6)}
#: Questions, or query vectors, that one pass over the candidates takes along as a constant.
AT_ONCE = 256
#: Numbers that a part of the rows, a block of the queries or a matrix of their products holds.
CELLS = 2_000_000


def weights(semantic: bool) -> tuple[float, float]:
    return WEIGHTS[bool(semantic)]


def _asked(queries: DataFrame, embedder) -> DataFrame:
    """(query_id, subject, asked, vector columns) of each question."""
    columns = ["query_id", "query", *(["subject"] if "subject" in queries.columns else [])]
    q = queries.select(*columns).withColumn("asked", token_set(F.col("query")))
    if embedder is not None:
        return q.withColumn("qv", embedder.column(F.col("query")))
    v = vectors(queries, "query_id", "query").select("query_id", F.map_entries("v").alias("qv"), F.col("square").alias("q_square"))
    return q.join(v, "query_id", "left")


def _blocks(rows: DataFrame) -> Iterator[Column]:
    """The rows as constants, AT_ONCE in each: a stated set, read once by the driver."""
    schema = rows.schema.simpleString()
    held: list[str] = []
    for r in rows.toLocalIterator():
        held.append(json.dumps(r.asDict(recursive=True)))
        if len(held) == AT_ONCE:
            yield F.from_json(F.lit(f"[{','.join(held)}]"), f"array<{schema}>")
            held = []
    if held:
        yield F.from_json(F.lit(f"[{','.join(held)}]"), f"array<{schema}>")


def _best(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """By the exact score; the shown one is rounded. Each task keeps k rows of a query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def rank(queries: DataFrame, edges: DataFrame, k: int, semantic: bool = False, by_subject: bool = False, embedder=None) -> DataFrame:
    """The k best edges of each (query_id, query[, subject]) row: score, then earlier recording, then fact_id.

    Edges carry fact_id, subject, predicate, object, tx_from. Nothing is cut by a
    threshold: edges that score zero fill up to k. With by_subject the candidates of a
    query are its subject's edges (an equi-join); else one pass scores every edge for
    AT_ONCE stated questions. Equal texts are embedded once. `embedder` gives a model's
    vectors in place of hashed ones.
    """
    if k < 1:
        raise ValueError("limit must be at least 1")
    w_sem, w_kw = weights(semantic if embedder is None else embedder.semantic)
    edges = edges.withColumn("text", edge_text(F.col("subject"), F.col("predicate"), F.col("object"))).select("fact_id", "subject", "predicate", "object", "tx_from", "text")
    texts = edges.select("text").distinct()
    if embedder is None:
        known, similar = vectors(texts, "text", "text"), lambda q: cosine(F.col("v"), F.col("square"), q["qv"], q["q_square"])
    else:
        known, similar = texts.withColumn("v", embedder.column(F.col("text"))), lambda q: F.coalesce(dot(F.col("v"), q["qv"]), F.lit(0.0))
    t = edges.join(known, "text", "left").withColumn("tokens", token_set(F.col("text")))
    asked = _asked(queries, embedder)
    if by_subject:
        of = asked.withColumnRenamed("subject", "of")
        pairs = [t.join(of.select("of", F.struct(*[c for c in of.columns if c != "of"]).alias("q")), F.col("subject") == F.col("of"))]
    else:
        pairs = [t.withColumn("q", F.explode(block)) for block in _blocks(asked.drop("query"))]
    if not pairs:
        pairs = [t.join(asked.select(F.struct(*asked.columns).alias("q")).limit(0), F.lit(True))]
    scored = None
    for p in pairs:
        own = p.withColumn("score", F.lit(w_sem) * F.coalesce(similar(F.col("q")), F.lit(0.0)) + F.lit(w_kw) * overlap(F.col("q.asked"), F.col("tokens")))
        own = own.select("q.query_id", "fact_id", "subject", "predicate", "object", "tx_from", "score")
        scored = own if scored is None else scored.unionByName(own)
    return _best(scored, k, "tx_from", "fact_id").select("query_id", "rank", "fact_id", "subject", "predicate", "object", "score")


def answer(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1").select("query_id", F.col("object").alias("answer"))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows with all rows, summed from the left as `dot` does."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += a[:, i, None] * b[None, :, i]
    return out


def _nearest(queries: pa.Table, rows: pa.Table, *, k: int) -> pa.Table:
    """The k best rows of each query: a matrix product finds all that can be among them, their exact scores decide.

    A product differs from the exact score by less than the bound of its rounding, so a row
    is passed over only where k others are surely better. Of equal rows those with the
    least ids are enough. All vectors are finite and of one length.
    """
    width = len(rows["embedding"][0])
    flat = lambda t: t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    ids, v = rows["vec_id"].to_numpy(), flat(rows)
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    seen: dict[bytes, list] = {}
    keep = np.zeros(len(v), bool)
    for i in range(len(v)):
        own = seen.setdefault(v[i].tobytes(), [0, None])
        if own[1] != ids[i]:
            own[0], own[1] = own[0] + 1, ids[i]
        keep[i] = own[0] <= k + 1  # one of them may be the query itself
    ids, v = ids[keep], v[keep]
    asked, q = queries["vec_id"].to_numpy(), flat(queries)
    slack = 8 * (width + 2) * 2.0**-53 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max()) + 1e-300
    found: list[tuple] = []
    step = max(1, CELLS // len(v))
    for lo in range(0, len(q), step):
        near = q[lo : lo + step] @ v.T
        near[asked[lo : lo + step, None] == ids[None, :]] = -np.inf
        least = (np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)) - 2 * slack[lo : lo + step]
        for at, (own, bound) in enumerate(zip(near, least), lo):
            c = np.flatnonzero((own >= bound) & (own > -np.inf))
            exact = _products(q[at : at + 1], v[c])[0]
            best = np.lexsort((ids[c], -exact))[:k]
            found += [(asked[at], ids[c[b]], exact[b]) for b in best]
    names = ["query_id", "vec_id", "score"]
    return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=names)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k nearest rows of each query vector among those with its label, by dot product.

    Rows of a label and width are dealt into parts of at most about CELLS numbers, queries
    into blocks; each block meets each part as two matrices, so that neither a label with
    most rows nor one with most queries is one task's. Vectors that are null, hold
    a null or a number without bounds are scored pair by pair.
    """
    size = F.size("embedding")
    bounded = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < 1e100))
    plain = F.coalesce(F.col("embedding").isNotNull() & (size > 0) & bounded, F.lit(False))

    def told(rows: DataFrame) -> DataFrame:
        cells = F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
        return rows.where("label IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").alias("label"), cells, F.when(plain, size).otherwise(0).alias("width"))

    v, q = told(vectors), told(queries)
    share = lambda t, name: t.where("width > 0").groupBy("label", "width").agg(F.ceil(F.count("*") * F.first("width") / CELLS).cast("int").alias(name))
    sizes = share(v, "parts").join(share(q, "blocks"), ["label", "width"])
    pair = F.xxhash64("vec_id")
    own = [F.col(c).alias(c) for c in ("vec_id", "label", "width", "embedding")]  # new columns: both sides come from one table
    rows = v.join(sizes, ["label", "width"]).select(*own, F.pmod(pair, F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = q.join(sizes, ["label", "width"]).select(*own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(pair, F.col("blocks")).cast("int").alias("block"))
    key = ["label", "width", "part", "block"]
    met = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(partial(_met, k=k), "query_id bigint, vec_id bigint, score double")
    # All other pairs: of different widths, or with a vector that is not plain.
    other = q.select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("qv"), F.col("width").alias("other_width")).join(v, "label").where("(other_width <> width OR width = 0) AND query_id <> vec_id")
    scored = met.unionByName(other.select("query_id", "vec_id", dot(F.col("embedding"), F.col("qv")).alias("score")))
    return _best(scored, k, "vec_id").select("query_id", "rank", "vec_id", "score")


def _met(queries: pa.Table, rows: pa.Table, *, k: int) -> pa.Table:
    if queries.num_rows and rows.num_rows:
        return _nearest(queries, rows, k=k)
    return pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]).empty_table()
