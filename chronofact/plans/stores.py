"""Queries through the facade, the store and the loaders, and of single functions; their SQL is in `store_oracle`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ports
from .. import schemas as S
from ..engine import Engine
from ..functions import text as T
from ..functions import vector as V
from ..operators import audit, evaluate, history, ingest, project
from ..sources import adapters as A
from ..sources import log as L
from ..sources.shared import folder, materialise

ROOT = b"an example of a root key, 32 byte"[:32]


def _events(spark, sf) -> DataFrame:
    """All facts as events to append, in the order of `events`."""
    f = A.facts(spark, sf)
    return f.select(
        F.lit(S.ASSERTED).alias("op"),
        "fact_id",
        "episode_id",
        "subject",
        "predicate",
        "object",
        F.col("valid_from").cast("timestamp").alias("valid_from"),
        F.lit(1.0).alias("confidence"),
        F.col("subject").alias("subject_id"),
        F.col("recorded_at").cast("timestamp").alias("recorded_at"),
        F.col("seq").alias("__order"),
    )


def _store(spark, sf, **how) -> Engine:
    """A new store with all facts, appended as three batches."""
    m = Engine(spark, folder(spark), **how)
    rows = _events(spark, sf)
    for part in (rows.where("__order <= 1000"), rows.where("__order > 1000 AND __order <= 2500"), rows.where("__order > 2500")):
        m.append(part)
    return m


def store_log(spark, sf):
    return _store(spark, sf).log().select("seq", "op", "fact_id", "object", F.unix_micros("recorded_at").alias("recorded_us"))


def store_audit(spark, sf):
    return _store(spark, sf).entries().select("seq", "kind", "ref", "payload_hash", "prev_hash", "entry_hash")


def store_compacted(spark, sf):
    m = _store(spark, sf)
    m.store.compact()
    found = m.verify_audit(deep=True)
    return m.log().agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"), F.lit(len(m)).cast("bigint").alias("stored")).withColumn("ok", F.lit(found.ok))


def _forgotten(spark, sf) -> tuple[Engine, list[str]]:
    m = _store(spark, sf, root_key=ROOT)
    gone = ["u17", "u34", "u51"]
    for s in gone:
        m.forget(s, "dpo")
    return m, gone


def facade_shred(spark, sf):
    m, _ = _forgotten(spark, sf)
    return m.log().where(F.col("op") == S.ASSERTED).select("seq", "fact_id", "subject_id", "object")


def facade_shred_check(spark, sf):
    """Chain, contents and register after three erasures, in one row."""
    m, _ = _forgotten(spark, sf)
    found, row = m.verify_audit(deep=True), m.evidence(deep=True)
    return spark.createDataFrame(
        [(found.ok, found.entries, row.erasures, row.certificates, row.ok)],
        "deep_ok boolean, entries bigint, erasures bigint, certificates bigint, ok boolean",
    )


def certificates(spark, sf):
    m, _ = _forgotten(spark, sf)
    return m.certificates().select("subject_id", "requested_by", "episodes_deleted", "facts_deleted", "manifest_hash", "algorithm", "dry_run")


def is_forgotten(spark, sf):
    m, gone = _forgotten(spark, sf)
    said = [(s, m.is_forgotten(s)) for s in [*gone, "u1", "u2"]]
    return spark.createDataFrame(said, "subject_id string, forgotten boolean")


def kept_fold(spark, sf):
    """Edges by a fold that was kept halfway and taken on from there."""
    log = materialise(ingest.to_log(ingest.edges(A.facts(spark, sf))))
    last = log.agg(F.max("seq").alias("s")).head().s
    from ..engine import KeptFold

    kept = KeptFold(spark, folder(spark))
    kept.refresh(log.where(F.col("seq") <= last // 2), last // 2)
    e = kept.edges(log, last)
    return e.select(
        "fact_id",
        "subject",
        "predicate",
        "object",
        F.unix_micros("valid_from").alias("valid_from_us"),
        F.unix_micros("valid_to").alias("valid_to_us"),
        F.unix_micros("tx_to").alias("tx_to_us"),
        "alive",
    )


def edges_upto(spark, sf):
    """The state after the event with number 5000."""
    log = ingest.to_log(ingest.edges(A.facts(spark, sf)))
    return project.fold(log.where("seq <= 5000")).select("fact_id", "object", "alive", F.col("pos").alias("seq"))


def subject_filter(spark, sf):
    """By entity name and by scope, each a column of its own."""
    e = ingest.edges(A.facts(spark, sf)).withColumn("subject_id", F.concat(F.lit("s"), F.col("seq") % 3))
    named = e.where("subject = 'u12'").select("fact_id", F.lit("name").alias("by"))
    return named.unionByName(project.live(e, "s1").select("fact_id", F.lit("scope").alias("by")))


def late_validity(spark, sf):
    """Facts whose validity runs backwards: the order of arrival closes them all the same."""
    back = A.facts(spark, sf).withColumn("valid_from", F.expr("timestamp_ntz'2030-01-01' - make_dt_interval(0, 0, 0, cast(seq as decimal(18,6)))"))
    return ingest.supersede_single(back).select("fact_id", "valid_from", "valid_to")


def cardinality(spark, sf):
    names = A.table(spark, sf, "events").select(F.col("event_type").alias("predicate")).distinct()
    more = names.sparkSession.createDataFrame([(p,) for p in ingest.MULTI] + [("lives_in",)], "predicate string")
    return ingest.cardinality(names.unionByName(more), {"click": True, "likes": False}).select("predicate", "multi")


def checked_times(spark, sf):
    """Dates as text, some malformed, as instants or null."""
    o = A.table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("13/"), F.col("o_orderkey").cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", F.unix_micros(T.checked_time(text)).alias("us"))


def iso_text(spark, sf):
    return A.table(spark, sf, "events").select("event_id", T.iso(F.col("ts")).alias("iso"))


def session_dates(spark, sf):
    """Labels of sessions in both known forms and in others."""
    c = A.table(spark, sf, "customer")
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.col("c_custkey").cast("int") % 400)
    label = F.when(
        F.col("c_custkey") % 4 == 0,
        F.concat(F.lit("1:56 pm on "), F.date_format(day, "d MMMM, y")),
    ).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("on "), F.date_format(day, "d MMMM y"))).when(F.col("c_custkey") % 4 == 2, F.lit("on some day"))
    return c.select("c_custkey", T.session_date(label, (F.col("c_custkey") % 20).cast("int")).alias("day"))


def redacted_dsn(spark, sf):
    c = A.table(spark, sf, "customer")
    dsn = F.concat(
        F.lit("postgresql://user"),
        F.col("c_custkey").cast("string"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(":pa$s"), F.col("c_custkey").cast("string"))),
        F.lit("@db.example.org:5432/x"),
    )
    return c.select("c_custkey", L.redacted(dsn).alias("shown"))


def unit_vectors(spark, sf):
    """Vectors of every length, one of them zero, as unit vectors."""
    e = A.table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5))
    u = V.normalise(v)
    return e.select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"), (F.round(F.element_at(u, 1), 6) + 0.0).alias("first"))


def digests_of_all_kinds(spark, sf):
    """The payload hash of each kind of event."""
    e = A.table(spark, sf, "events")
    key, k = F.col("event_id").cast("string"), F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    kinds = F.array(*[F.lit(x) for x in (S.EPISODE, S.ASSERTED, S.INVALIDATED, S.MERGED, S.UNMERGED, S.FORGOTTEN)])
    op = F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int"))
    at = F.col("ts").cast("timestamp")
    odd = F.col("event_id") % 4 == 1
    rows = e.select(
        (F.col("event_id") + 1).alias("seq"), op.alias("op"), F.concat(F.lit("e"), key).alias("episode_id"), F.sha2("props", 256).alias("content_hash"), F.col("props").alias("payload"),
        F.when(odd, F.concat(F.lit("src|"), key)).alias("source_ref"), F.concat(F.lit("f"), key).alias("fact_id"), F.col("event_type").alias("subject"), F.lit("p|q").alias("predicate"), k.alias("object"),
        at.alias("valid_from"), F.when(odd, at).alias("valid_to"), F.round(F.col("event_id") % 7 / 7, 6).alias("confidence"), F.when(
            odd,
            F.struct((F.col("event_id") % 9).cast("int").alias("lo"), F.lit(12).alias("hi")),
        ).alias("char_span"),
        F.lit("superseded").alias("reason"), F.when(odd, F.concat(F.lit("f"), key)).alias("superseded_by"), F.concat(F.lit("c"), key).alias("canonical_id"), k.alias("alias_id"), F.when(odd, F.lit("é|x")).alias("evidence"), F.lit("dpo").alias("requested_by"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_id"), F.when(odd, F.lit("agent")).alias("agent_id"), F.lit(None).cast("string").alias("session_id"), F.lit("org").alias("org_id"), at.alias("recorded_at"),
    )
    return audit.payloads(L.complete(rows))


def edge_rows(spark, sf):
    """Edges as JSON, as a server would send them."""
    e = ingest.edges(A.facts(spark, sf)).withColumn("confidence", F.lit(0.5)).withColumn("subject_id", F.lit(None).cast("string"))
    return history.edge_json(e)


def whole_spans(spark, sf):
    """Spans with both ends, else none."""
    e = A.table(spark, sf, "events")
    lo, hi = F.when(F.col("event_id") % 3 != 0, F.col("event_id")), F.when(F.col("event_id") % 4 != 0, F.col("event_id") + 5)
    return e.select("event_id", history.span(lo, hi).alias("s")).select("event_id", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))


def replayed_facts(spark, sf):
    """Facts extracted before, joined to their messages."""
    m = A.messages(spark, sf)
    known = ingest.extract(m).select("episode_id", "pos", "predicate", "object", "rule").where("rule <> 3").drop("rule")
    out = ports.ReplayExtractor(known, "episode_id").extract(m)
    return out.select("episode_id", "subject", "predicate", "object", F.col("span_lo").cast("bigint").alias("span_lo"), F.col("span_hi").cast("bigint").alias("span_hi"))


def evaluation_file(spark, sf):
    """An evaluation set written as a file of JSON and read back: questions with their episodes' count."""
    n = A.table(spark, sf, "nation")
    episode = F.struct(
        F.concat(F.lit("I live in "), "n_name", F.lit(".")).alias("text"),
        F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("subject_id"),
        F.lit("2020-01-01").alias("valid_from"),
    )
    question = F.struct(
        F.lit("where").alias("query"),
        F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("subject_id"),
        F.col("n_name").alias("expected"),
        F.when(F.col("n_nationkey") % 2 == 0, "2021-01-01").alias("as_of"),
    )
    path = folder(spark)
    n.agg(F.to_json(F.struct(
        F.lit("nations").alias("name"),
        F.collect_list(episode).alias("episodes"),
        F.collect_list(question).alias("questions"),
    )).alias("value")).coalesce(1).write.text(path)
    episodes, questions = A.evaluation_set(spark, path)
    return questions.join(episodes, "subject_id").select("subject_id", "query", "expected", "as_of", "text", "valid_from")


def conversation_turns(spark, sf):
    """Conversations in the form of session lists, read turn by turn."""
    c = A.table(spark, sf, "conversations")
    turn = F.struct(F.col("role").alias("speaker"), F.concat_ws(":", F.lit("D"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("dia_id"), "text")
    lists = c.withColumn("s", F.col("turn") % 11 + 1).groupBy("conv_id", "s").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))),
        lambda x: x["t"],
    ).alias("ts"))
    named = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("session_"), F.col("s").cast("string")), F.to_json("ts"))))
    whole = lists.groupBy("conv_id").agg(named.alias("m"))
    body = F.concat(F.lit('{"conversation":{'), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}}"))
    out = A.turns_of(whole.select("conv_id", body.alias("value")), sessions=3, turns=4)
    return out.select("conv_id", F.col("session").cast("bigint").alias("session"), "date", F.col("at").cast("bigint").alias("place"), "speaker", "dia_id")


def scorable_questions(spark, sf):
    """Questions whose evidence is all ingested, of categories but 5."""
    d = A.table(spark, sf, "documents").select("doc_id").distinct()
    near = lambda x: F.col("doc_id") + x
    evidence = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<bigint>")).when(F.col("doc_id") % 4 == 0, F.array(near(0), near(1))).otherwise(F.array(near(0)))
    q = d.select("doc_id", (F.col("doc_id") % 5 + 1).alias("category"), evidence.alias("evidence"))
    known = d.where("doc_id % 10 <> 1")
    return evaluate.scorable_among(q, known, "doc_id").select("doc_id", "category")


def keyword_ranks(spark, sf):
    """Density of a question's words in each benchmark item."""
    b = A.table(spark, sf, "benchmark")
    return b.select("item_id", F.round(T.keyword_rank(F.lit("What is the answer of the question and the model"), F.col("text")), 6).alias("rank"))


def merge_events(spark, sf):
    """Merges and unmerges through the store's log, then the aliases that they leave."""
    from .catalogue import merge_log

    m = Engine(spark, folder(spark))
    m.append(merge_log(spark, sf).withColumnRenamed("seq", "__order"))
    return m.resolve()


def resolved_names(spark, sf):
    """Names given by the caller: the automatic band becomes merges in the log."""
    m = Engine(spark, folder(spark))
    m.resolve_entities([r.p_name for r in A.table(spark, sf, "part").select("p_name").where("p_name IS NOT NULL").distinct().collect()])  # a caller's list
    return m.log().select("op", "canonical_id", "alias_id", F.regexp_replace("evidence", "^auto:", "").cast("double").alias("score"))


def first_places(spark, sf):
    """Nodes of the graph numbered by their first appearance."""
    e = ingest.edges(A.facts(spark, sf))
    first = history.first_appearance(e)
    return first.select("id", "kind", F.col("place").cast("bigint").alias("place"))


def name_bands(spark, sf):
    """The resolver port over nations and regions."""
    names = A.table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(A.table(spark, sf, "region").select(F.col("r_name").alias("name")))
    return ports.NameResolver().resolve(names)


_NAMES = """store_log store_audit store_compacted facade_shred facade_shred_check certificates is_forgotten kept_fold edges_upto subject_filter
late_validity cardinality checked_times iso_text session_dates redacted_dsn unit_vectors digests_of_all_kinds edge_rows whole_spans
replayed_facts evaluation_file conversation_turns scorable_questions keyword_ranks merge_events resolved_names first_places
name_bands""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
