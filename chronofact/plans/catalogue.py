"""All queries of the engine by name; their SQL is in `oracle`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest as D
from ..functions import text as T
from ..functions import vector as V
from ..operators import audit, erase, evaluate, govern, history, ingest, project, recall, resolve
from ..sources import adapters as A
from ..sources import log as L
from . import store_oracle, stores
from .oracle import ORACLE



def at():
    """The instant of the point-in-time queries."""
    return F.lit("2024-01-15").cast("timestamp_ntz")


def edges(spark, sf):
    return ingest.edges(A.facts(spark, sf))


def _scoped(e: DataFrame) -> DataFrame:
    return e.withColumn("subject_id", F.col("subject"))


def event_log(spark, sf):
    return ingest.to_log(edges(spark, sf))


def log_union_scan(spark, sf):
    f = A.facts(spark, sf)
    episodes = f.select((F.col("seq") * 2 - 1).alias("seq"), F.lit("episode").alias("op"), "episode_id", "payload", F.col("subject").alias("subject_id"))
    facts = f.select((F.col("seq") * 2).alias("seq"), F.lit("asserted").alias("op"), "episode_id", "fact_id", "object", F.lit(None).cast("string").alias("subject_id"))
    return L.union_ordered(episodes, facts).select("seq", "op", "episode_id", "fact_id", "object", "payload", "subject_id")


def log_json_roundtrip(spark, sf):
    back = L.decode_json(L.encode_json(event_log(spark, sf)))
    return back.select(
        "seq",
        "op",
        "fact_id",
        "subject",
        "predicate",
        "object",
        F.unix_micros("valid_from").alias("valid_from_us"),
        F.unix_micros("valid_to").alias("valid_to_us"),
        F.unix_micros("recorded_at").alias("recorded_us"),
    )


def log_digest(spark, sf):
    return audit.payloads(event_log(spark, sf))


def extract_spans(spark, sf):
    x = ingest.extract(A.messages(spark, sf))
    return x.select(
        "episode_id",
        "subject",
        "predicate",
        "object",
        F.col("span_lo").cast("bigint").alias("span_lo"),
        F.col("span_hi").cast("bigint").alias("span_hi"),
        (F.substring(F.col("text"), F.col("span_lo") + 1, F.col("span_hi") - F.col("span_lo")) == F.col("object")).alias("exact"),
    )


def extract_facts(spark, sf):
    return ingest.extract(A.messages(spark, sf)).groupBy("predicate", "object").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


def dedup_multi(spark, sf):
    return ingest.dedup_multi(A.facts(spark, sf)).select("seq", "fact_id", "subject", "predicate", "object")


def supersede_single(spark, sf):
    return ingest.supersede_single(A.facts(spark, sf)).select("seq", "fact_id", "subject", "predicate", "object", "valid_from", "valid_to")


def priorities(spark, sf):
    """A customer's orders of one year as one message that names several priorities."""
    o = A.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("episode_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"),
        F.lit("priority").alias("predicate"),
        F.col("o_orderpriority").alias("object"),
        F.col("o_orderdate").alias("valid_from"),
        F.col("o_custkey"),
        F.year("o_orderdate").alias("y"),
    )


def ingest_exact(spark, sf):
    from pyspark.sql import Window

    p = priorities(spark, sf)  # messages come in the order of years
    p = p.withColumn("seq", F.row_number().over(Window.partitionBy("o_custkey").orderBy("y", "seq")).cast("bigint"))
    return ingest.exact_changes(p).select("subject", "seq", "object", "valid_from")


def edges_all(spark, sf):
    f = project.fold(event_log(spark, sf))
    return f.select(
        "fact_id",
        "subject",
        "predicate",
        "object",
        F.unix_micros("valid_from").alias("valid_from_us"),
        F.unix_micros("valid_to").alias("valid_to_us"),
        F.unix_micros("tx_to").alias("tx_to_us"),
        "alive",
    )


def edges_live(spark, sf):
    return project.live(edges(spark, sf)).select("fact_id", "subject", "predicate", "object", "valid_from")


def edges_asof(spark, sf):
    return project.as_of(edges(spark, sf), at()).select("subject", "predicate", "object", "valid_from", "valid_to")


def asof_join(spark, sf):
    u = A.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject")).distinct()
    days = F.explode(F.array(*[F.lit(f"2024-01-{d:02d}").cast("timestamp_ntz") for d in (5, 15, 25)])).alias("t")
    return project.as_of_join(u.select("subject", days), edges(spark, sf)).groupBy("subject", "t").agg(F.count("*").alias("n_facts"), F.min("object").alias("least_object"))


def merge_log(spark, sf):
    """Merges and unmerges of customers in their order: some chains, some rings, some undone."""
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    merged = c.select(
        (F.col("k") * 2).alias("seq"),
        F.lit("entity_merged").alias("op"),
        name(F.col("k")).alias("alias_id"),
        name(F.when(F.col("k") % 10 == 9, F.col("k") - 9).otherwise(F.col("k") + 1)).alias("canonical_id"),
    ).where("(seq / 2) % 4 <> 3 OR (seq / 2) % 20 > 9")
    undone = c.where("k % 6 = 0").select(
        (F.col("k") * 2 + 1).alias("seq"),
        F.lit("entity_unmerged").alias("op"),
        name(F.col("k")).alias("alias_id"),
        name(F.when(F.col("k") % 12 == 0, F.col("k") + 1).otherwise(F.col("k") + 2)).alias("canonical_id"),
    )
    return L.complete(merged.unionByName(undone))


def alias_state(spark, sf):
    return project.alias_state(merge_log(spark, sf))


def alias_sets(spark, sf):
    return project.alias_sets(merge_log(spark, sf)).select("canonical_id", F.array_join("aliases", ",").alias("aliases"))


def alias_resolve(spark, sf):
    return project.alias_resolve(spark, alias_state(spark, sf))


def entities(spark, sf):
    return project.entities(edges(spark, sf), merge_log(spark, sf).where("op = 'entity_merged'"))


def forgotten_filter(spark, sf):
    return project.without_forgotten(_scoped(edges(spark, sf)), A.tombstones(spark, sf)).select("fact_id", "subject", "predicate", "object")


def timeline(spark, sf):
    return history.timeline(edges(spark, sf)).select("subject", "fact_id", "valid_from", "alive", F.col("place").cast("bigint").alias("place"))


def provenance(spark, sf):
    m = A.messages(spark, sf)
    x = ingest.extract(m).select("episode_id", "subject", "predicate", "object", "span_lo", "span_hi")
    p = history.provenance(x, m.select("episode_id", F.col("text").alias("payload")))
    return p.select("episode_id", "subject", "predicate", "object", "snippet")


def conflicts(spark, sf):
    return history.conflicts(edges(spark, sf))


def graph_nodes(spark, sf):
    return history.graph_nodes(edges(spark, sf))


def graph_edges(spark, sf):
    return history.graph_edges(edges(spark, sf))


def _episodes_and_facts(spark, sf):
    f = A.facts(spark, sf)
    row = F.explode(F.array(
        F.struct(F.lit("episode").alias("op"), F.col("episode_id").alias("i")),
        F.struct(F.lit("asserted").alias("op"), F.col("fact_id").alias("i")),
    )).alias("x")
    made = f.select((F.col("seq") * 2).alias("seq"), row, F.col("subject").alias("subject_id")).select(
        (F.col("seq") + F.when(F.col("x.op") == "episode", 0).otherwise(1)).alias("seq"),
        "x.op",
        F.when(F.col("x.op") == "episode", F.col("x.i")).alias("episode_id"),
        F.when(F.col("x.op") == "asserted", F.col("x.i")).alias("fact_id"),
        "subject_id",
    )
    gone = A.tombstones(spark, sf).select(
        (F.substring("subject_id", 2, 18).cast("bigint") + 10_000_000_000).alias("seq"),
        F.lit("subject_forgotten").alias("op"),
        "subject_id",
        F.lit("dpo").alias("requested_by"),
    )
    return L.complete(made.unionByName(gone, allowMissingColumns=True))


def _keyring(spark, sf):
    """Keys of all subjects but every other forgotten one."""
    e = A.table(spark, sf, "events").where("user_id % 17 <> 0 OR user_id % 34 = 0")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_id")).distinct()


def erased_refs(spark, sf):
    return audit.erased_refs(_episodes_and_facts(spark, sf), _keyring(spark, sf))


def key_intact(spark, sf):
    return _scoped(edges(spark, sf)).join(_keyring(spark, sf), "subject_id", "left_semi").select("fact_id", "subject")


def tokens(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", F.explode(T.token_set(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("docs"))


def keyword_overlap(spark, sf):
    """Tokens of a benchmark item that a document shares, best document of each item: an equi-join on tokens."""
    from pyspark.sql import Window

    b = A.table(spark, sf, "benchmark").select("item_id", T.token_set(F.col("text")).alias("asked"))
    d = A.table(spark, sf, "documents").select("doc_id", F.explode(T.token_set(F.col("text"))).alias("token"))
    hits = d.join(b.select("item_id", F.size("asked").alias("n"), F.explode("asked").alias("token")), "token").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("hits"))
    scored = hits.select("item_id", "doc_id", F.round(F.col("hits") / F.col("n"), 6).alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("item_id", "doc_id", "score")


def hash_embed(spark, sf):
    v = V.sparse(A.table(spark, sf, "benchmark"), "item_id", "text")
    return v.select("item_id", "bucket", F.round("w", 6).alias("w"))


def vector_topk(spark, sf):
    e = A.table(spark, sf, "embeddings")
    return recall.vector_topk(e, e.where("vec_id % 20 = 0"), 5).select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "score")


def _questions(spark):
    rows = [(1, "what did u12 purchase", "u12"), (2, "u7 click k3", "u7"), (3, "signup of u40 k9", "u40"), (4, "errors", "u3")]
    return spark.createDataFrame(rows, "query_id bigint, query string, subject string")


def _ranked(spark, e, **how):
    r = recall.rank(_questions(spark), e.withColumn("tx_from", F.col("recorded_at")), 5, **how)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "fact_id", "object", "score")


def hybrid_topk(spark, sf):
    return _ranked(spark, project.live(edges(spark, sf)))


def hybrid_topk_asof(spark, sf):
    return _ranked(spark, project.as_of(edges(spark, sf), at()), by_subject=True)


def weights_semantic(spark, sf):
    return _ranked(spark, project.live(edges(spark, sf)), semantic=True)


def answer(spark, sf):
    return recall.answer(hybrid_topk(spark, sf))


def er_names(spark, sf):
    return resolve.names_of(edges(spark, sf))


def er_pairs(spark, sf):
    return resolve.pairs(A.names(spark, sf)).select("a", "b", F.round("score", 6).alias("score"))


def er_bands(spark, sf):
    return resolve.bands(resolve.similar(A.names(spark, sf)))


def _numbered(spark, sf):
    """Payload hashes of all assertions, numbered by event: every event is an entry."""
    f = A.facts(spark, sf)
    return f.select(
        "seq",
        F.lit("asserted").alias("kind"),
        F.col("fact_id").alias("ref"),
        D.sha(F.concat_ws("|", "fact_id", "subject", "predicate", "object")).alias("payload_hash"),
    )


def chain_links(spark, sf):
    return audit.build(_numbered(spark, sf)).select("seq", "prev_hash", "entry_hash")


def chain_head(spark, sf):
    return audit.head(audit.build(_numbered(spark, sf)))


def chain_blocks(spark, sf):
    return audit.build_blocks(_numbered(spark, sf))


def chain_verify(spark, sf):
    return audit.verify_links(audit.build(_numbered(spark, sf)))


def chain_verify_tampered(spark, sf):
    entries = audit.build(_numbered(spark, sf))
    bad = entries.withColumn("payload_hash", F.when(F.col("seq") == 777, D.sha(F.lit("x"))).otherwise(F.col("payload_hash")))
    return audit.verify_links(bad).select("ok", "entries", "broken_at")


def _log_and_entries(spark, sf):
    log = L.complete(A.facts(spark, sf).select(
        "seq",
        F.lit("asserted").alias("op"),
        "fact_id",
        "episode_id",
        "subject",
        "predicate",
        "object",
        F.col("valid_from").cast("timestamp"),
        F.lit(1.0).alias("confidence"),
        F.col("subject").alias("subject_id"),
        F.col("recorded_at").cast("timestamp"),
    ))
    return log, audit.build(audit.payloads(log))


def deep_verify(spark, sf):
    return audit.verify_deep(*_log_and_entries(spark, sf))


def deep_verify_tampered(spark, sf):
    log, entries = _log_and_entries(spark, sf)
    return audit.verify_deep(log.withColumn("object", F.when(F.col("seq") == 500, F.lit("forged")).otherwise(F.col("object"))), entries)


def deep_verify_shred(spark, sf):
    """Rows of shredded subjects are unreadable; the chain still holds, as their refs are erased for good."""
    log, entries = _log_and_entries(spark, sf)
    gone = A.tombstones(spark, sf)
    erased = log.join(gone, "subject_id", "left_semi").select(D.event_ref().alias("ref"))
    return audit.verify_deep(project.without_forgotten(log, gone), entries, erased)


def _parts(spark, sf):
    f = A.facts(spark, sf)
    return f.select("episode_id", F.col("subject").alias("subject_id")), _scoped(edges(spark, sf))


def forget_preview(spark, sf):
    return erase.counts(*_parts(spark, sf), A.tombstones(spark, sf))


def manifest_hash(spark, sf):
    return erase.preview(*_parts(spark, sf), A.tombstones(spark, sf)).select("subject_id", "manifest_hash")


def _requests(spark, sf):
    e = A.table(spark, sf, "events").where("user_id % 17 = 0 AND event_type = 'error'")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_id"),
        F.concat(F.lit("op"), (F.col("event_id") % 3).cast("string")).alias("requested_by"),
        F.col("ts").alias("recorded_at"),
        F.col("event_id").alias("seq"),
    )


def erasure_register(spark, sf):
    left = project.without_forgotten(_scoped(edges(spark, sf)), A.tombstones(spark, sf).where("subject_id <> 'u34'"))
    return erase.register(_requests(spark, sf), left)


def subject_check(spark, sf):
    everyone = A.facts(spark, sf).select(F.col("subject").alias("subject_id"))
    left = project.without_forgotten(_scoped(edges(spark, sf)), A.tombstones(spark, sf).where("subject_id <> 'u34'"))
    return erase.subject_check(everyone, A.tombstones(spark, sf), left)


def evidence_summary(spark, sf):
    return erase.evidence(chain_verify(spark, sf), erasure_register(spark, sf), _requests(spark, sf).select("subject_id", "requested_by").distinct())


def crypto_roundtrip(spark, sf):
    f = A.facts(spark, sf).select("seq", F.col("subject").alias("subject_id"), "object", "payload")
    keys = f.select("subject_id").distinct().withColumn("key", F.unhex(F.sha2(F.concat(F.lit("example"), "subject_id"), 256)))
    sealed = erase.encrypt(f, keys)
    back = erase.decrypt(sealed, keys.join(A.tombstones(spark, sf), "subject_id", "left_anti"))
    return back.select("seq", "subject_id", "object", "payload")


def reconcile_downstream(spark, sf):
    kept = A.facts(spark, sf).where("seq % 5 = 0").select(F.col("subject").alias("subject_id"), F.col("payload").alias("text")).where("substring(subject_id, 2, 18) % 34 = 0")
    return govern.reconcile(A.tombstones(spark, sf), kept)


def accuracy(spark, sf):
    m = ingest.extract(A.messages(spark, sf)).where("predicate = 'lives_in'").select(F.col("object").alias("got"), F.col("subject"))
    c, n = A.table(spark, sf, "customer"), A.table(spark, sf, "nation")
    want = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("subject"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("nowhere")).otherwise(F.lower("n_name")).alias("expected"),
    )
    return evaluate.accuracy(want.join(m, "subject", "left"))


def recall_at_k(spark, sf):
    best = keyword_overlap(spark, sf).select("item_id", F.array(F.col("doc_id").cast("string")).alias("retrieved"))
    d, b = A.table(spark, sf, "documents"), A.table(spark, sf, "benchmark")
    first = d.select("doc_id", F.explode(T.token_set(F.col("text"))).alias("token")).join(
        b.select("item_id", F.size(T.token_set(F.col("text"))).alias("n"), F.explode(T.token_set(F.col("text"))).alias("token")),
        "token",
    )
    whole = first.groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("h")).where("h = n").groupBy("item_id").agg(F.collect_list(F.col("doc_id").cast("string")).alias("evidence"))
    return evaluate.recall_at_k(best.join(whole, "item_id"))


def latency_percentiles(spark, sf):
    return evaluate.nearest_rank(A.table(spark, sf, "events"), "event_type", "value")


def human_turns(spark, sf):
    return A.table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"))


def open_facts(spark, sf):
    return edges(spark, sf).where("valid_to IS NULL").select("fact_id", T.display(F.col("subject"), F.col("predicate"), F.col("object")).alias("shown"))


def generated_bench(spark, sf):
    return ingest.extract(A.generated_messages(spark, 200)).groupBy("predicate").agg(F.count("*").alias("n"), F.min("object").alias("least"))


def _run_stream(made, path):
    made.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _shared(spark):
    from ..sources.shared import folder

    return folder(spark)


def _fact_stream(spark, sf):
    e = A.table(spark, sf, "events")
    raw = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet" if _is_folder(spark, f"{sf}/events.parquet") else f"{sf}/events[.]parquet")
    return raw


def _is_folder(spark, path) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _single_stream(spark, sf):
    e = _fact_stream(spark, sf).where("event_type IN ('signup', 'error')")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("fact_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("object"),
        F.col("ts").cast("timestamp").alias("valid_from"),
    )


def _streamed_edges(spark, sf):
    from ..streaming import ingest as S

    path = _shared(spark)
    _run_stream(S.upsert_edges(S.supersede(_single_stream(spark, sf)), f"{path}/changes"), path)
    return S.edges_of(spark, f"{path}/changes")


def stream_supersede(spark, sf):
    return _streamed_edges(spark, sf).select("seq", "fact_id", "subject", "predicate", "object")


def stream_edges(spark, sf):
    e = _streamed_edges(spark, sf)
    return e.select("fact_id", "subject", "predicate", "object", F.unix_micros("valid_from").alias("valid_from_us"), F.unix_micros("valid_to").alias("valid_to_us"))


def stream_window_counts(spark, sf):
    """Windows that the watermark has closed: the rest stays open until later events come."""
    from ..streaming import ingest as S

    path = _shared(spark)
    counts = S.window_counts(_fact_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{path}/counts").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("window_start timestamp, event_type string, n bigint").parquet(f"{path}/counts").select(
        F.unix_micros("window_start").alias("window_us"),
        "event_type",
        "n",
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_topk_asof(spark, sf)


_NAMES = """log_union_scan log_json_roundtrip log_digest extract_facts extract_spans dedup_multi supersede_single ingest_exact
edges_all edges_live edges_asof asof_join entities alias_state alias_sets alias_resolve forgotten_filter key_intact timeline provenance
conflicts graph_nodes graph_edges erased_refs tokens keyword_overlap hash_embed vector_topk hybrid_topk hybrid_topk_asof
weights_semantic answer er_names er_pairs er_bands chain_head chain_links chain_blocks chain_verify chain_verify_tampered deep_verify
deep_verify_tampered deep_verify_shred forget_preview manifest_hash erasure_register subject_check evidence_summary crypto_roundtrip
reconcile_downstream accuracy recall_at_k latency_percentiles human_turns open_facts generated_bench stream_supersede stream_edges
stream_window_counts""".split()
QUERIES = {n: globals()[n] for n in _NAMES} | stores.QUERIES
ORACLE = ORACLE | store_oracle.ORACLE
__all__ = ["ORACLE", "QUERIES", "flagship"]
