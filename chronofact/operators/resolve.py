"""Entity resolution: pairs of names, their scores and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_similarity, name_tokens
from ..functions.vector import cosine, vectors

# Scores from which a pair is merged, or shown for review.
AUTO, REVIEW = 0.85, 0.5
#: Names are compared with names in cells of this many times this many blocks.
BLOCKS = 24


def names_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("subject", "object")).alias("name")).where("name IS NOT NULL").distinct()


def _described(names: DataFrame) -> DataFrame:
    """(name, tokens, v, square) of each distinct name."""
    n = names.select("name").where("name IS NOT NULL").distinct()
    return n.join(vectors(n, "name", "name"), "name", "left").withColumn("tokens", name_tokens(F.col("name")))


def _scored(met: DataFrame, with_vectors: bool = True) -> DataFrame:
    """Pairs (x, y) of described names with their score."""
    score = lexical_similarity(F.col("x.name"), F.col("y.name"), F.col("x.tokens"), F.col("y.tokens"))
    if with_vectors:
        score = F.greatest(score, cosine(F.col("x.v"), F.col("x.square"), F.map_entries("y.v"), F.col("y.square")))
    return met.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), score.alias("score"))


def pairs(names: DataFrame, with_vectors: bool = True, blocks: int = BLOCKS) -> DataFrame:
    """(a, b, score) of all names a < b: all pairs of distinct names are the operator's definition.

    A name goes into the row and the column of its block, and the names that meet in a cell
    are joined by the cell's number: an equi-join of bounded cells whatever the names are.
    """
    d = _described(names).withColumn("block", F.pmod(F.hash("name"), F.lit(blocks)))
    each = F.sequence(F.lit(0), F.lit(blocks - 1))
    whole = F.struct("name", "tokens", "v", "square")
    across = d.select(whole.alias("x"), F.explode(F.transform(each, lambda i: F.col("block") * blocks + i)).alias("cell"))
    down = d.select(whole.alias("y"), F.explode(F.transform(each, lambda i: i * blocks + F.col("block"))).alias("cell"))
    return _scored(across.join(down, "cell").where("x.name < y.name"), with_vectors)


def _rare_first(d: DataFrame, keys) -> DataFrame:
    """(name, key, weight, place): the keys of each name, the rarest first; `weight` is their share of its squared length."""
    rows = d.select("name", F.explode(keys).alias("k")).select("name", "k.key", "k.weight")
    count = rows.groupBy("key").agg(F.count("*").alias("n"))
    rare = Window.partitionBy("name").orderBy("n", "key")
    return rows.join(count, "key").withColumn("place", F.row_number().over(rare)).withColumn("before", F.sum("weight").over(rare) - F.col("weight"))


def likely(names: DataFrame) -> DataFrame:
    """(a, b), a < b: candidates among which are all pairs with a score of REVIEW or more.

    Edit similarity of a half or more: neither name is over twice as long, and their
    letters that the longer one has alone are half of it at most; names meet by length.
    Token sets of which one holds the other, or whose Jaccard similarity is a half or more:
    one of the rarest tokens of either, all but the last half, is in the other. A cosine of a
    half or more: so is one of the buckets that are not in a last quarter of squared length.
    """
    d = _described(names).select("name", "tokens", "v", "square", F.length(F.lower("name")).alias("n"))
    letters = F.array_sort(F.split(F.lower("name"), ""))
    sized = d.select("name", "n", letters.alias("letters"))
    longer = sized.select(F.col("name").alias("x"), F.col("n").alias("nx"), F.col("letters").alias("lx"))
    # A name meets those of its own length and of the shorter ones down to a half.
    reach = longer.withColumn("m", F.explode(F.sequence(F.ceil(F.col("nx") / 2).cast("int"), F.col("nx"))))
    near = reach.join(sized, (F.col("m") == F.col("n")) & ((F.col("n") < F.col("nx")) | (F.col("name") < F.col("x"))))
    near = near.where(F.size(F.array_except("lx", "letters")) <= F.col("nx") / 2).select("x", F.col("name").alias("y"))
    one = F.lit(1).cast("bigint")
    shared = None
    for keys, kept in (
        (F.transform("tokens", lambda t: F.struct(t.alias("key"), one.alias("weight"))), F.col("before") <= F.col("total") / 2),
        (F.transform(F.map_entries("v"), lambda e: F.struct(e["key"].alias("key"), (e["value"] * e["value"]).alias("weight"))), F.col("before") <= 0.76 * F.col("total")),
    ):
        ranked = _rare_first(d, keys)
        total = ranked.groupBy("name").agg(F.sum("weight").alias("total"))
        first = ranked.join(total, "name").where(kept).select(F.col("name").alias("x"), "key")
        own = first.join(ranked.select(F.col("name").alias("y"), "key"), "key").where("x <> y").select("x", "y")
        shared = own if shared is None else shared.unionByName(own)
    both = near.unionByName(shared)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar(names: DataFrame) -> DataFrame:
    """(a, b, score) of the pairs a < b with a score of REVIEW or more, found without comparing all."""
    d = _described(names)
    whole = F.struct("name", "tokens", "v", "square")
    x, y = d.select(F.col("name").alias("a"), whole.alias("x")), d.select(F.col("name").alias("b"), whole.alias("y"))
    return _scored(likely(names).join(x, "a").join(y, "b")).where(F.round("score", 9) >= REVIEW)


def bands(scored: DataFrame) -> DataFrame:
    """(canonical_id, alias_id, score, band): the longer name stands for the pair, of equals the first; scores are shown at three places."""
    s = F.round("score", 9)
    band = F.when(s >= AUTO, "auto").when(s >= REVIEW, "review")
    first = F.length("a") >= F.length("b")
    return scored.withColumn("band", band).where("band IS NOT NULL").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical_id"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("alias_id"),
        F.round("score", 3).alias("score"),
        "band",
    )


def merges(decided: DataFrame) -> DataFrame:
    """Merge events of the pairs in the automatic band."""
    return decided.where("band = 'auto'").select(
        F.lit("entity_merged").alias("op"),
        "canonical_id",
        "alias_id",
        F.concat(F.lit("auto:"), F.col("score").cast("string")).alias("evidence"),
    )
