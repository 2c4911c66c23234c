"""Quality and latency figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise


def accuracy(answers: DataFrame) -> DataFrame:
    """Share of (got, expected) rows whose answer contains the expected text, in any case."""
    hit = F.coalesce(F.contains(F.lower("got"), F.lower("expected")), F.lit(False))
    return answers.agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


def recall_at_k(found: DataFrame) -> DataFrame:
    """Share of questions of which one evidence id was retrieved; (retrieved, evidence) arrays."""
    hit = F.arrays_overlap("retrieved", "evidence")
    return found.agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"), F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 6).alias("recall"))


def scorable(questions: DataFrame, ingested) -> DataFrame:
    """Questions of categories other than 5 with evidence, all of it ingested."""
    return questions.where((F.col("category") != 5) & (F.size("evidence") > 0)).where(F.forall("evidence", lambda x: F.array_contains(ingested, x)))


def scorable_among(questions: DataFrame, ingested: DataFrame, column: str) -> DataFrame:
    """As `scorable`, against a table of ingested ids: no question stays whose evidence is missing there."""
    asked = questions.where((F.col("category") != 5) & (F.size("evidence") > 0)).withColumn("__q", F.struct(*questions.columns))
    each = asked.select("__q", F.explode("evidence").alias("__e"))
    missing = each.join(ingested.select(F.col(column).alias("__i")).distinct(), F.col("__e") == F.col("__i"), "left_anti").select("__q").distinct()
    return asked.join(missing, "__q", "left_anti").drop("__q")


def nearest_rank(values: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Percentiles of each group: the sorted sample at round(p/100 * n) - 1, within bounds; nulls take no part.

    Equal values are counted first; their running count is taken within ranges of values,
    to which the counts of the ranges before are added, so a group is as many tasks as it has ranges.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    parted = materialise(counted.repartitionByRange(group, "v").withColumn("part", F.spark_partition_id()))
    sums = parted.groupBy(group, "part").agg(F.sum("n").alias("in_part"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    sums = sums.select(group, "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("below"), F.sum("in_part").over(Window.partitionBy(group)).alias("total"))
    within = Window.partitionBy(group, "part").orderBy("v")
    rows = parted.withColumn("upto", F.sum("n").over(within)).join(sums, [group, "part"]).withColumn("upto", F.col("upto") + F.col("below"))
    place = lambda p: F.greatest(F.lit(1), F.least(F.col("total"), F.bround(F.lit(p / 100) * F.col("total")).cast("bigint")))
    # The least value whose count up to and with it reaches the place.
    return rows.groupBy(group).agg(*[F.min(F.when(F.col("upto") >= place(p), F.col("v"))).alias(f"p{p}") for p in percents])
