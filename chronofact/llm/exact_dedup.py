"""Exact deduplication by 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, materialise

#: Bits that tell which hashes may occur twice, in words of 64: at most so many words are broadcast, whatever the data.
FILTER_WORDS = 1 << 18
#: Members of one group that compare against one copy of its first text.
MEMBERS_AT_ONCE = 5_000


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK, " ")


def hash128(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def _may_recur(hashes: DataFrame, several: DataFrame) -> DataFrame:
    """Rows whose hash `h` may be among those of `several`; all that are stay, of others few.

    A bit for each hash by its 64-bit value; the words that have one are at most FILTER_WORDS,
    so they are broadcast. With far more hashes than bits it lets all through.
    """
    place = F.pmod(F.xxhash64("h"), F.lit(64 * FILTER_WORDS))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    words = several.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    held = hashes.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(words), F.col("__word") == F.col("word"))
    return held.where(F.call_function("shiftright", F.col("bits"), F.col("__bit")).bitwiseAND(F.lit(1).cast("bigint")) == 1).drop("__word", "__bit", "word", "bits")


def groups(docs: DataFrame) -> DataFrame:
    """For each row of docs its group of equal texts.

    (doc_id, keep_id, group_size, kept, text_sha256). Texts are equal if identical
    after each run of ASCII white space becomes one space; null counts as empty. Rows
    are grouped by the MD5 of that text; then each member's bytes are compared with
    those of the group's first row, and rows that differ form groups by their bytes.
    The smallest doc_id stays; a null doc_id comes after all others. Repeated rows
    count each, and are kept or dropped together. An empty table gives no row.

    Only ids and hashes are shuffled for the counts, combined before the shuffle; the
    texts of groups of two or more, told apart by a broadcast filter, are compared, and a large group is dealt over as
    many tasks as it has blocks of MEMBERS_AT_ONCE rows.
    """
    norm = docs.select("doc_id", normalised().alias("norm"))
    keyed = norm.select("doc_id", hash128(F.col("norm")).alias("h"), F.sha2(F.col("norm"), 256).alias("text_sha256"))
    keyed = materialise(keyed, "keyed")
    # Written, so that joins with it have an exchange on both sides and a hot hash can be split.
    count = materialise(keyed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "counts")
    several = count.where("n > 1")
    members = keyed.select("doc_id", "h").distinct().join(several, "h")
    parts = F.ceil(F.col("n") / MEMBERS_AT_ONCE).cast("int")
    members = members.select("doc_id", "h", "first_id", F.pmod(F.hash("doc_id"), parts).alias("part"), parts.alias("parts"))
    # Ids come to the texts by an equi-join on both keys: a repeated doc_id with another text is not mixed up.
    texts = _may_recur(norm.withColumn("h", hash128(F.col("norm"))), several).alias("t")
    texts = texts.join(members.alias("m"), F.expr("t.doc_id <=> m.doc_id AND t.h = m.h")).select("t.*", "first_id", "part", "parts")
    texts = materialise(texts, "copies")
    firsts = texts.where("doc_id <=> first_id").dropDuplicates(["h"]).select(
        "h",
        F.col("norm").alias("first_norm"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    compared = texts.join(firsts, ["h", "part"]).select("doc_id", "h", F.when(F.col("norm") != F.col("first_norm"), F.col("norm")).alias("odd"))
    odd = materialise(compared.where("odd IS NOT NULL").withColumn("odd_key", F.sha2("odd", 256)), "odd")
    # MD5 collisions, if any, are whole in `odd`: there the bytes themselves are the key.
    odd_groups = odd.groupBy("h", "odd").agg(F.min("doc_id").alias("odd_first"), F.count("*").alias("odd_n"))
    odd_rows = odd.join(odd_groups, ["h", "odd"]).select("h", F.col("odd_key").alias("text_sha256"), "odd_first", "odd_n").distinct()
    lost = odd_rows.groupBy("h").agg(F.sum("odd_n").alias("lost"))
    out = keyed.join(count, "h").join(lost, "h", "left").join(odd_rows, ["h", "text_sha256"], "left")
    keep, size = F.coalesce("odd_first", "first_id"), F.coalesce("odd_n", F.col("n") - F.coalesce("lost", F.lit(0)))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row with a smaller doc_id has; all columns stay.

    Of repeated rows with the same doc_id and text one stays, and a null doc_id is a value.
    """
    key = lambda doc_id, sha: F.concat_ws("/", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), sha)
    stay = groups(docs).where("kept").select(key("doc_id", F.col("text_sha256")).alias("__key")).distinct()
    # Join and removal of repeated rows share one key, so each text is shuffled once.
    joined = docs.withColumn("__key", key("doc_id", F.sha2(normalised(), 256))).join(stay, "__key", "left_semi")
    return joined.dropDuplicates(["__key"]).select(*docs.columns)
