"""The fold of the log into edges, entities and aliases, and the views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.shared import materialise


_FIELDS = ("subject", "predicate", "object", "valid_from", "valid_to", "confidence", "episode_id", "char_span", "subject_id", "recorded_at")


def fold_state(log: DataFrame) -> DataFrame:
    """What the fold keeps of each fact: its last assertion, the place of its first one, its last invalidation.

    One shuffle by fact_id, combined before it.
    """
    asserted, gone = F.col("op") == S.ASSERTED, F.col("op") == S.INVALIDATED
    rows = log.where(F.col("op").isin(S.ASSERTED, S.INVALIDATED))
    last = rows.groupBy("fact_id").agg(
        F.max_by(F.when(asserted, F.struct("seq", *_FIELDS)), F.when(asserted, F.col("seq"))).alias("a"),
        F.min(F.when(asserted, F.col("seq"))).alias("pos"),
        F.max_by(F.when(gone, F.struct("seq", "valid_to", "recorded_at")), F.when(gone, F.col("seq"))).alias("i"),
    )
    gone = (F.col("i.seq").alias("gone_at"), F.col("i.valid_to").alias("gone_to"), F.col("i.recorded_at").alias("gone_recorded"))
    return last.select("fact_id", "pos", F.col("a.seq").alias("asserted_at"), *[F.col(f"a.{c}").alias(c) for c in _FIELDS], *gone)


def merge_state(before: DataFrame, after: DataFrame) -> DataFrame:
    """The state of a log from that of its beginning and that of its rest: what came later counts."""
    both = before.alias("b").join(after.alias("n"), F.col("b.fact_id") == F.col("n.fact_id"), "full")
    later = lambda at, names: [F.when(F.col(f"n.{at}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in names]
    return both.select(
        F.coalesce("b.fact_id", "n.fact_id").alias("fact_id"),
        F.least("b.pos", "n.pos").alias("pos"),
        *later("asserted_at", ("asserted_at", *_FIELDS)),
        *later("gone_at", ("gone_at", "gone_to", "gone_recorded")),
    )


def edges_of(state: DataFrame) -> DataFrame:
    """Edges: an assertion is closed by an invalidation after it. Invalidations of unknown facts do nothing."""
    closed = F.coalesce(F.col("gone_at") > F.col("asserted_at"), F.lit(False))
    known = [F.col(c) for c in _FIELDS if c not in ("valid_to", "recorded_at")]
    out = state.where("asserted_at IS NOT NULL").select(
        "fact_id",
        "pos",
        *known,
        F.col("recorded_at").alias("tx_from"),
        F.when(closed, F.col("gone_to")).otherwise(F.col("valid_to")).alias("valid_to"),
        F.when(closed, F.col("gone_recorded")).alias("tx_to"),
    )
    return out.withColumn("alive", F.col("valid_to").isNull())


def fold(log: DataFrame) -> DataFrame:
    """The edges of a log."""
    return edges_of(fold_state(log))


def without_forgotten(rows: DataFrame, tombstones: DataFrame, column: str = "subject_id") -> DataFrame:
    """Rows whose subject has no tombstone; a tombstone holds for good, wherever it stands in the log."""
    gone = tombstones.select(F.col("subject_id").alias("__gone")).distinct()
    return rows.join(gone, F.col(column) == F.col("__gone"), "left_anti")


def live(edges: DataFrame, subject_id: str | None = None) -> DataFrame:
    return edges.where("alive") if subject_id is None else edges.where(F.col("alive") & (F.col("subject_id") == subject_id))


def holds_at(t: Column) -> Column:
    """valid_from <= t < valid_to, an open end being later than all."""
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))


def as_of(edges: DataFrame, t: Column, subject_id: str | None = None) -> DataFrame:
    """Edges valid at t, superseded ones included."""
    out = edges.where(holds_at(t))
    return out if subject_id is None else out.where(F.col("subject_id") == subject_id)


def as_of_join(probes: DataFrame, edges: DataFrame) -> DataFrame:
    """For (subject, t) probes the edges valid then: an equi-join on the subject with the interval as residue."""
    e = edges.withColumnRenamed("subject", "__s")
    return probes.join(e, F.col("subject") == F.col("__s")).where(holds_at(F.col("t"))).drop("__s")


def entities(edges: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Ids of all subjects and merge targets; objects are none."""
    ids = edges.select(F.col("subject").alias("entity_id"))
    return (ids if merges is None else ids.unionByName(merges.select(F.col("canonical_id").alias("entity_id")))).distinct()


def alias_state(log: DataFrame) -> DataFrame:
    """(alias_id, canonical_id) after replaying merges and unmerges: an unmerge counts only against the current target.

    The current target is that of the last merge, unless an unmerge of the same pair came
    after it; unmerges of other pairs change nothing. So aggregates do, without a list.
    """
    merged = F.col("op") == S.MERGED
    rows = log.where(F.col("op").isin(S.MERGED, S.UNMERGED)).select("alias_id", "canonical_id", "seq", merged.alias("merged"))
    pairs = rows.groupBy("alias_id", "canonical_id").agg(F.max(F.when(F.col("merged"), F.col("seq"))).alias("made"), F.max(F.when(~F.col("merged"), F.col("seq"))).alias("undone"))
    last = pairs.where("made IS NOT NULL").groupBy("alias_id").agg(F.max_by(F.struct("canonical_id", "made", "undone"), "made").alias("x"))
    return last.where("x.undone IS NULL OR x.undone < x.made").select("alias_id", F.col("x.canonical_id").alias("canonical_id"))


def alias_sets(log: DataFrame) -> DataFrame:
    """(canonical_id, aliases): pairs whose last event is a merge."""
    rows = log.where(F.col("op").isin(S.MERGED, S.UNMERGED)).groupBy("canonical_id", "alias_id").agg(F.max_by("op", "seq").alias("last"))
    return rows.where(F.col("last") == S.MERGED).groupBy("canonical_id").agg(F.sort_array(F.collect_set("alias_id")).alias("aliases"))


def alias_resolve(spark: SparkSession, aliases: DataFrame) -> DataFrame:
    """(alias_id, resolved): follow targets until there is none, or until one comes again; that one is the result.

    Pointers are doubled: after a round each alias points twice as far, so rounds are the
    logarithm of the longest chain. Whatever still points on after as many rounds as there
    could be leads into a ring; there the first alias that lies on the ring is the one that
    comes again. Lineage is cut after each round.
    """
    one = aliases.select("alias_id", "canonical_id").where("canonical_id IS NOT NULL")
    jumps = [materialise(one.select(F.col("alias_id").alias("a"), F.col("canonical_id").alias("to")))]
    n = jumps[0].count()
    while 1 << len(jumps) <= n:
        last = jumps[-1]
        ahead = last.select(F.col("a").alias("at"), F.col("to").alias("then"))
        further = materialise(last.join(ahead, F.col("to") == F.col("at")).select("a", F.col("then").alias("to")))
        if further.isEmpty():  # no chain is that long
            break
        jumps.append(further)
    else:
        # Some chains are as long as there are aliases can be: rings. After n steps all on them are on a ring.
        last = jumps[-1]
        ahead = last.select(F.col("a").alias("at"), F.col("to").alias("then"))
        ring = materialise(last.join(ahead, F.col("to") == F.col("at")).select(F.col("then").alias("ring")).distinct())
        return _with_rings(jumps, ring)
    return _ends(jumps)


def _ends(jumps: list[DataFrame]) -> DataFrame:
    """The last target of each alias, by the farthest jumps that there are."""
    at = jumps[0].select(F.col("a").alias("alias_id"), F.col("to").alias("resolved"))
    for jump in reversed(jumps):
        step = jump.select("a", "to")
        at = materialise(at.join(step, F.col("resolved") == F.col("a"), "left").select("alias_id", F.coalesce("to", "resolved").alias("resolved")))
    return at


def _with_rings(jumps: list[DataFrame], ring: DataFrame) -> DataFrame:
    """As _ends; aliases that lead into a ring stop at the first alias on it (those on it at themselves)."""
    on = ring.select(F.col("ring").alias("r"))
    first = jumps[0].join(on, F.col("a") == F.col("r"), "left").select("a", "to", F.col("r").isNotNull().alias("on_ring"))
    done = first.where("on_ring").select(F.col("a").alias("alias_id"), F.col("a").alias("resolved"))
    # Without the links between aliases on a ring all that is left are chains.
    chains = [materialise(first.where("NOT on_ring").select("a", "to"))]
    while True:
        last = chains[-1]
        ahead = last.select(F.col("a").alias("at"), F.col("to").alias("then"))
        further = materialise(last.join(ahead, F.col("to") == F.col("at")).select("a", F.col("then").alias("to")))
        if further.isEmpty():
            return done.unionByName(_ends(chains))
        chains.append(further)
