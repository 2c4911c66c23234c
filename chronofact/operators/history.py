"""Timelines, provenance, conflicts and the graph of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso
from ..sources.shared import materialise


def timeline(edges: DataFrame) -> DataFrame:
    """Edges of each subject in the order of validity, then of appending."""
    w = Window.partitionBy("subject").orderBy("valid_from", "seq")
    return edges.select("subject", "fact_id", "predicate", "object", "valid_from", "valid_to", "alive", F.row_number().over(w).alias("place"))


def provenance(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """The source of each fact and the snippet that it was read from; null without a span or an episode."""
    src = episodes.select(F.col("episode_id").alias("__e"), F.col("payload").alias("__p"), *([c for c in ("source_ref",) if c in episodes.columns]))
    joined = facts.join(src, F.col("episode_id") == F.col("__e"), "left")
    snippet = F.when(F.col("span_lo").isNotNull() & F.col("span_hi").isNotNull(), F.substring(F.col("__p"), F.col("span_lo") + 1, F.col("span_hi") - F.col("span_lo")))
    return joined.withColumn("snippet", snippet).drop("__e", "__p")


def conflicts(edges: DataFrame) -> DataFrame:
    """Single-valued keys that ever had two or more values, with their values by validity.

    Keys are found by counts; the list of values is made of these only, and is the result itself.
    """
    single = edges.where("NOT multi")
    found = single.groupBy("subject", "predicate").agg(F.min("object").alias("least"), F.max("object").alias("most"), F.min("seq").alias("first_seq")).where("least <> most")
    own = single.select("subject", "predicate", "object", "valid_from", "seq").join(found.select("subject", "predicate", "first_seq"), ["subject", "predicate"])
    different = own.groupBy("subject", "predicate", "object").agg(F.lit(1).alias("one")).groupBy("subject", "predicate").agg(F.count("*").alias("n_values"))
    listed = own.groupBy("subject", "predicate").agg(F.sort_array(F.collect_list(F.struct("valid_from", "seq", "object"))).alias("xs"), F.min("first_seq").alias("first_seq"))
    values = F.array_join(F.transform("xs", lambda x: x["object"]), ",")
    return listed.join(different, ["subject", "predicate"]).select(
        "subject",
        "predicate",
        "n_values",
        values.alias("value_list"),
        F.lit("recency").alias("resolution"),
        "first_seq",
    )


def graph_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("fact_id").alias("edge_id"), F.col("subject").alias("source"), F.col("predicate").alias("label"), F.col("object").alias("target"), "alive")


def _ends(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(
        F.struct(F.col("subject").alias("id"), F.lit("entity").alias("kind"), F.lit(0).alias("end")),
        F.struct(F.col("object").alias("id"), F.lit("value").alias("kind"), F.lit(1).alias("end")),
    ))
    rows = edges.select("valid_from", "seq", ends.alias("x"))
    order = F.struct("valid_from", "seq", "x.end")
    return rows.groupBy("x.id").agg(F.min_by("x.kind", order).alias("kind"), F.min(order).alias("first")).select("id", "kind", "first")


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Names of subjects and objects; the first appearance in timeline order says which kind a node is."""
    return _ends(edges).select("id", "kind")


def first_appearance(edges: DataFrame) -> DataFrame:
    """(id, kind, place): nodes numbered by their first appearance, range by range, without one task for all."""
    ranged = materialise(_ends(edges).repartitionByRange("first").sortWithinPartitions("first").withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33)))
    before = ranged.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__part")) - F.col("n"))  # a row for each task
    return ranged.join(F.broadcast(before), "__part").select("id", "kind", (F.col("__before") + F.col("__at") + 1).alias("place"))


def edge_json(edges: DataFrame) -> DataFrame:
    """(fact_id, row): each edge as JSON of ten fields, times as ISO text."""
    fields = (
        "fact_id",
        "subject",
        "predicate",
        "object",
        iso(F.col("valid_from")).alias("valid_from"),
        iso(F.col("valid_to")).alias("valid_to"),
        "alive",
        "confidence",
        "subject_id",
        F.col("episode_id").alias("source_episode_id"),
    )
    return edges.select("fact_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("row"))


def span(lo, hi):
    """Both ends of a span, or null."""
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))
