"""Hashed bag-of-words vectors and dot products.

A token falls into bucket h mod dim with the sign of bit 1 of h, where h is its 64-bit
BLAKE2b, big-endian. Spark has no BLAKE2b, so an Arrow function hashes each distinct
token once; all else is built-in. Vectors stay sparse and whole-numbered, so that dot
products of equal texts are equal to the last bit.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .text import words

DIM = 384
#: Names of a map entry's fields.
_KEY, _VALUE = "key", "value"


@F.pandas_udf(LongType())
def _blake(tokens: pd.Series) -> pd.Series:
    """The hash as a signed number; null stays null."""
    return tokens.map(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True), na_action="ignore")


def token_places(tokens: DataFrame, token: str = "tok", dim: int = DIM) -> DataFrame:
    """(tok, bucket, sign) of the distinct tokens."""
    hashed = tokens.select(F.col(token).alias("tok")).distinct().withColumn("h", _blake("tok"))
    high, low = F.shiftrightunsigned("h", 1), F.col("h").bitwiseAND(1)  # h as unsigned: 2 * high + low
    bucket = ((high % dim) * 2 + low) % dim
    return hashed.select("tok", bucket.cast("int").alias("bucket"), F.when(high % 2 == 1, 1).otherwise(-1).alias("sign"))


def components(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, bucket, s): the non-zero sums of signs of each row; rows without tokens have none."""
    parts = df.select(key, F.explode(words(F.col(text))).alias("tok")).groupBy(key, "tok").agg(F.count("*").alias("n"))
    placed = parts.join(token_places(parts, "tok", dim), "tok")
    return placed.groupBy(key, "bucket").agg(F.sum(F.col("n") * F.col("sign")).alias("s")).where("s <> 0")


def vectors(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, v, square): one row for each that has components; v is a map from bucket to sum, square its squared length."""
    pairs = F.collect_list(F.struct("bucket", "s"))  # at most `dim` of them
    rows = components(df, key, text, dim).groupBy(key).agg(F.map_from_entries(pairs).alias("v"), F.sum(F.col("s") * F.col("s")).alias("square"))
    return rows


def sparse(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, bucket, w): the non-zero components of each row's unit vector."""
    v = vectors(df, key, text, dim)
    return v.select(key, "square", F.explode("v").alias("bucket", "s")).select(key, "bucket", (F.col("s") / F.sqrt("square")).alias("w"))


def cosine(v: Column, square: Column, entries: Column, other: Column) -> Column:
    """Of two whole-numbered vectors, a map and the entries of another, with their squared lengths; 0 where one is missing."""
    dot = F.aggregate(entries, F.lit(0).cast("bigint"), lambda total, x: total + x[_VALUE] * F.coalesce(F.try_element_at(v, x[_KEY]), F.lit(0)))
    return F.coalesce(dot / F.sqrt(square.cast("double") * other), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Dot product up to the shorter vector's end."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def dense(v: Column, square: Column, dim: int = DIM) -> Column:
    """A sparse vector as an array of `dim` unit components; null gives zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(v, i) / F.sqrt(square), F.lit(0.0)))
