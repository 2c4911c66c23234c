"""Text to facts, duplicates out, older values closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Predicates and their triggers, in the order in which rules apply.
RULES = [
    ("name_is", "my name is|i am|i'm"),
    ("lives_in", "i live in|i now live in|i moved to|i relocated to"),
    ("works_at", "i work at|i work for|i joined|i now work at"),
    ("uses", "i use|i switched to|i now use|i prefer"),
]
# Predicates of which a subject holds many.
MULTI = ("uses", "speaks_language", "likes", "knows", "owns", "visited", "interested_in", "member_of")


def pattern(triggers: str) -> str:
    """Triggers in any case, at a word's start; then blanks and a capital A-Z with at least one word character more."""
    return rf"(?U)(?iu:\b(?:{triggers}))\s+([A-Z]\w+)"


def _found(text: Column, rule: int, predicate: str, rx: str) -> Column:
    """All matches as (rule, pos, predicate, object, lo, hi): a match ends with its value, so lengths give the span."""
    whole, value = F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.regexp_extract_all(text, F.lit(rx), F.lit(1))
    between = F.slice(F.split(text, rx, -1), F.lit(1), F.size(whole))
    sizes = F.zip_with(between, whole, lambda a, b: F.length(a) + F.length(b))
    ends = F.slice(F.aggregate(sizes, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))), F.lit(2), F.size(whole))
    rows = F.transform(
        F.arrays_zip(value.alias("o"), ends.alias("e")),
        lambda x, i: F.struct(
            F.lit(rule).alias("rule"),
            i.alias("pos"),
            F.lit(predicate).alias("predicate"),
            x["o"].alias("object"),
            (x["e"] - F.length(x["o"])).alias("lo"),
            x["e"].alias("hi"),
        ),
    )
    none = F.array().cast("array<struct<rule:int,pos:int,predicate:string,object:string,lo:int,hi:int>>")
    return F.when(F.size(whole) > 0, rows).otherwise(none)


def extract(messages: DataFrame, text: str = "text") -> DataFrame:
    """One row for each fact found, in rule order; the subject is the scope's, or the word subject."""
    found = F.flatten(F.array(*[_found(F.coalesce(F.col(text), F.lit("")), i, p, pattern(t)) for i, (p, t) in enumerate(RULES)]))
    rows = messages.withColumn("__x", F.explode(found))
    return rows.select(
        *messages.columns,
        F.coalesce("subject_id", F.lit("subject")).alias("subject"),
        F.col("__x.rule").alias("rule"),
        F.col("__x.pos").alias("pos"),
        F.col("__x.predicate").alias("predicate"),
        F.col("__x.object").alias("object"),
        F.col("__x.lo").alias("span_lo"),
        F.col("__x.hi").alias("span_hi"),
    )


def cardinality(facts: DataFrame, declared: dict[str, bool] | None = None, default_multi: bool = False) -> DataFrame:
    """Add `multi`: whether a subject may hold many values of the predicate."""
    known = {p: True for p in MULTI} | (declared or {})
    pairs = F.create_map(*[x for p, m in known.items() for x in (F.lit(p), F.lit(m))])
    return facts.withColumn("multi", F.coalesce(F.try_element_at(pairs, F.col("predicate")), F.lit(default_multi)))


def first_in_message(facts: DataFrame, message: str = "episode_id", order: str = "seq") -> DataFrame:
    """The first of equal triples of one message."""
    w = Window.partitionBy(message, "subject", "predicate", "object").orderBy(order)
    return facts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_multi(facts: DataFrame) -> DataFrame:
    """First occurrences of many-valued triples."""
    w = Window.partitionBy("subject", "predicate", "object").orderBy("seq")
    return facts.where("multi").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def supersede_single(facts: DataFrame) -> DataFrame:
    """Changes of single-valued keys; the next change closes a value. Order is that of appending."""
    key = Window.partitionBy("subject", "predicate").orderBy("seq")
    kept = facts.where("NOT multi").withColumn("__p", F.lag("object").over(key)).where("__p IS NULL OR __p <> object").drop("__p")
    return kept.withColumn("valid_to", F.lead("valid_from").over(key)).withColumn("tx_to", F.lead("recorded_at").over(key))


def edges(facts: DataFrame) -> DataFrame:
    """The edge table of a log in which no message names two values for one single-valued key.

    One shuffle by (subject, predicate) serves all windows: the triple's first place is
    a minimum over the same partition.
    """
    key = Window.partitionBy("subject", "predicate")
    first = F.row_number().over(Window.partitionBy("subject", "predicate", "object").orderBy("seq"))
    before = F.lag("object").over(key.orderBy("seq"))
    kept = facts.withColumn("__n", first).withColumn("__p", before).where("(multi AND __n = 1) OR (NOT multi AND (__p IS NULL OR __p <> object))").drop("__n", "__p")
    closes = lambda c: F.when(~F.col("multi"), F.lead(c).over(key.orderBy("seq")))
    out = kept.withColumn("valid_to", closes("valid_from")).withColumn("tx_to", closes("recorded_at"))
    return out.withColumn("alive", F.col("valid_to").isNull())


def exact_changes(facts: DataFrame) -> DataFrame:
    """Changes of single-valued keys where a message may name several values.

    A value that was live when the message began is dropped when the message names it
    again, even if it was superseded in between. So a message keeps all its values but the
    one it starts with, and leaves its last one behind, or the one before if it started with
    the last. Whether it leaves the last is a bit that a message sets, passes on or turns:
    the last set one and the number of turns since give it, by windows over one shuffle.
    """
    key = Window.partitionBy("subject", "predicate").orderBy("seq")
    once = first_in_message(facts).withColumn("__new", F.when(F.lag("episode_id").over(key).eqNullSafe(F.col("episode_id")), 0).otherwise(1))
    once = once.withColumn("__run", F.sum("__new").over(key))
    message = ["subject", "predicate", "__run"]
    ranked = once.withColumn("__n", F.row_number().over(Window.partitionBy(*message).orderBy(F.desc("seq"))))
    value = lambda n: F.max(F.when(F.col("__n") == n, F.col("object")))
    ends = ranked.groupBy(*message).agg(value(1).alias("__last"), value(2).alias("__second"))
    runs = Window.partitionBy("subject", "predicate").orderBy("__run")
    before = lambda c: F.lag(c).over(runs)
    two = F.col("__second").isNotNull()
    from_last = ~(two & before("__last").eqNullSafe(F.col("__last")))
    from_second = F.when(before("__second").isNull(), from_last).otherwise(~(two & before("__second").eqNullSafe(F.col("__last"))))
    bits = ends.select(*message, "__last", "__second", from_last.alias("__f"), from_second.alias("__s"))
    bits = bits.withColumn(
        "__set",
        F.when(F.col("__f") == F.col("__s"), F.col("__f").cast("int")),
    ).withColumn("__turns", F.sum((~F.col("__f") & F.col("__s")).cast("int")).over(runs))
    since = F.col("__turns") - F.last(F.when(F.col("__set").isNotNull(), F.col("__turns")), ignorenulls=True).over(runs)
    left = bits.withColumn("__bit", (F.last("__set", ignorenulls=True).over(runs) + since) % 2)
    left = left.withColumn("__now", F.when(F.col("__bit") == 1, F.col("__last")).otherwise(F.col("__second")))
    starts = left.select(*message, F.lag("__now").over(runs).alias("__start"))
    kept = once.join(starts, message).where("__start IS NULL OR __start <> object")
    return kept.select("subject", "predicate", "seq", "episode_id", "object", "valid_from")


def to_log(edge: DataFrame) -> DataFrame:
    """Asserted and invalidated events of an edge table; an invalidation stands just before the assertion that caused it."""
    from ..sources.log import complete

    key = Window.partitionBy("subject", "predicate").orderBy("seq")
    cause = edge.withColumn("next_seq", F.when(~F.col("multi"), F.lead("seq").over(key)))
    made = complete(cause.select(
        (F.col("seq") * 2 + 1).alias("seq"),
        F.lit("asserted").alias("op"),
        "episode_id",
        "fact_id",
        "subject",
        "predicate",
        "object",
        F.col("valid_from").cast("timestamp"),
        F.lit(1.0).alias("confidence"),
        F.col("subject").alias("subject_id"),
        F.col("recorded_at").cast("timestamp"),
    ))
    gone = complete(cause.where("next_seq IS NOT NULL").select(
        (F.col("next_seq") * 2).alias("seq"),
        F.lit("invalidated").alias("op"),
        "fact_id",
        F.lit("superseded").alias("reason"),
        F.col("valid_to").cast("timestamp"),
        F.col("tx_to").cast("timestamp").alias("recorded_at"),
    ))
    return made.unionByName(gone)
