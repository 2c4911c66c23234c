"""Relational tables as inputs of the engine: facts, sentences, names, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import session_date


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each row of `events`; click, view and purchase hold many values, others one."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("fact_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("episode_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("object"),
        F.col("ts").alias("valid_from"),
        F.col("ts").alias("recorded_at"),
        F.col("event_type").isin("click", "view", "purchase").alias("multi"),
        F.col("props").alias("payload"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of customers: name, nation and segment, then an employer with each order."""
    c, n, o = (table(spark, sf_dir, x) for x in ("customer", "nation", "orders"))
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit("_"))
    first = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("episode_id"),
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("subject_id"),
        F.format_string("My name is %s. I live in %s and I use %s.", name, F.col("n_name"), F.initcap("c_mktsegment")).alias("text"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("valid_from"),
    )
    later = o.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("episode_id"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("subject_id"),
        F.concat(F.lit("I now work at Status_"), F.col("o_orderstatus"), F.lit(".")).alias("text"),
        F.col("o_orderdate").alias("valid_from"),
    )
    return first.unionByName(later)


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("user_id % 17 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_id")).distinct()


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).where("name IS NOT NULL").distinct()


def generated_messages(spark: SparkSession, n: int) -> DataFrame:
    """One three-sentence message for each of n subjects."""
    i = F.col("id").cast("string")
    return spark.range(n).select(
        F.concat(F.lit("u"), i).alias("subject_id"),
        F.format_string("My name is User%s. I live in City%s and I work at Org%s.", i, i, i).alias("text"),
        F.lit("2020-01-01").cast("timestamp").alias("valid_from"),
    )


def evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(episodes, questions) of a JSON file {name, episodes: [...], questions: [...]}."""
    schema = "name string, episodes array<struct<text:string,subject_id:string,valid_from:string>>, questions array<struct<query:string,subject_id:string,expected:string,as_of:string>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    return whole.select(F.explode("episodes").alias("x")).select("x.*"), whole.select(F.explode("questions").alias("x")).select("x.*")


def turns_of(samples: DataFrame, sessions: int | None = None, turns: int | None = None) -> DataFrame:
    """(session, date, at, speaker, dia_id, text[, key columns]) of JSON texts `value` with session_N lists, in the order of their numbers.

    Columns beside `value` tell samples apart; of each the first `sessions` sessions and the
    first `turns` turns are taken, all if these are not given.
    """
    keys = [c for c in samples.columns if c != "value"]
    body = samples.select(*keys, F.expr("from_json(get_json_object(value, '$.conversation'), 'map<string,string>')").alias("m"))
    named = F.filter(F.map_keys("m"), lambda k: k.rlike("^session_[0-9]+$"))
    ordered = F.array_sort(F.transform(named, lambda k: F.struct(F.substring_index(k, "_", -1).cast("int").alias("session"), k.alias("k"))))
    each = F.transform(
        ordered,
        lambda x, i: F.struct(
            x["session"].alias("session"),
            session_date(F.element_at("m", F.concat(x["k"], F.lit("_date_time"))), i).alias("date"),
            F.element_at("m", x["k"]).alias("v"),
        ),
    )
    rows = body.select(*keys, F.explode(each if sessions is None else F.slice(each, 1, sessions)).alias("x"))
    rows = rows.select(*keys, "x.session", "x.date", F.from_json("x.v", "array<struct<speaker:string,dia_id:string,text:string>>").alias("turns"))
    out = rows.select(*keys, "session", "date", F.posexplode("turns").alias("at", "t")).select(*keys, "session", "date", "at", "t.*")
    if turns is None:
        return out
    w = Window.partitionBy(*keys).orderBy("session", "at") if keys else Window.orderBy("session", "at")  # one conversation
    return out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= turns).drop("__n")


def conversation_turns(spark: SparkSession, path: str, sessions: int | None = None, turns: int | None = None) -> DataFrame:
    """The turns of a JSON file; see turns_of."""
    return turns_of(spark.read.text(path, wholetext=True), sessions, turns)


def extract_resumably(turns: DataFrame, extractor, path: str) -> DataFrame:
    """Facts of all turns, a folder for each session: a run that was stopped goes on after the last whole one."""
    spark = turns.sparkSession
    for r in turns.select("session").distinct().orderBy("session").collect():  # the sessions of a conversation
        folder = f"{path}/session={r.session}"
        if "_SUCCESS" not in _names(spark, folder):
            own = turns.where(F.col("session") == r.session).drop("session").withColumn("subject_id", F.col("speaker"))
            extractor.extract(own).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(path)


def _names(spark, folder: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
