"""The facade: a store of facts under a path, with the operations of a memory service.

Each call is a Spark job. Bulk ingestion uses operators.ingest directly. With a root key
the contents of a subject are sealed under its own key before they are written.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from . import ports
from . import schemas as S
from .functions.digest import GENESIS, event_digest, event_ref
from .operators import audit, erase, history, ingest, project, recall, resolve
from .sources import files
from .sources import log as L
from .sources.keyring import FileKeyring
from .sources.shared import materialise

#: Writers that meet try again so often.
ATTEMPTS = 200
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)


def instant(when) -> datetime.datetime | None:
    """ISO text or a datetime as an instant; without a zone it is UTC. A malformed text is a ValueError."""
    if when is None:
        return None
    when = datetime.datetime.fromisoformat(when) if isinstance(when, str) else when
    return when if when.tzinfo else when.replace(tzinfo=datetime.UTC)


class KeptFold:
    """Edges from a fold that is kept under the store, and from the log's rows after it.

    What a fold needs of each fact is written after a write once `every` events have come;
    readers fold only what is newer. Contents are sealed there, too.
    """

    def __init__(self, spark: SparkSession, path: str, keyring=None, every: int = 1000):
        self.spark, self.path, self.keyring, self.every = spark, path, keyring, every

    def _last(self, upto: int) -> tuple[int, str | None]:
        known = [n for n in files.names(self.spark, f"{self.path}/at") if int(n.split(".")[0]) <= upto]
        return (int(known[-1].split(".")[0]), json.loads(files.read(self.spark, f"{self.path}/at/{known[-1]}"))["folder"]) if known else (0, None)

    def _state(self, log: DataFrame, last_seq: int) -> DataFrame:
        at, folder = self._last(last_seq)
        if folder is None:
            return project.fold_state(log)
        before = self.spark.read.schema(S.FOLD).parquet(f"{self.path}/{folder}")
        if self.keyring is not None:
            before = erase.decrypt(before, self.keyring.frame(), ("object",), F.col("asserted_at").isNotNull())
        return before if at == last_seq else project.merge_state(before, project.fold_state(log.where(F.col("seq") > at)))

    def edges(self, log: DataFrame, last_seq: int) -> DataFrame:
        return project.edges_of(self._state(log, last_seq))

    def refresh(self, log: DataFrame, last_seq: int, anew: bool = False) -> None:
        """Keep the fold up to last_seq; older ones go. `anew` folds the whole log again."""
        state = project.fold_state(log) if anew else self._state(log, last_seq)
        if self.keyring is not None:
            state = erase.encrypt(state, self.keyring.frame(), ("object",))
        older, folder = files.names(self.spark, f"{self.path}/at"), f"fold-{uuid.uuid4().hex}"
        state.select(*S.FOLD.fieldNames()).write.parquet(f"{self.path}/{folder}")
        name = f"{last_seq:012d}.json"
        if name in older:  # the same place anew
            files.delete(self.spark, f"{self.path}/at/{name}")
        if not files.publish(self.spark, f"{self.path}/at/{name}", json.dumps({"folder": folder})):
            files.delete(self.spark, f"{self.path}/{folder}")
        for n in older[:-1]:  # one is left for readers that began before
            if n != name:
                files.delete(self.spark, f"{self.path}/at/{n}")

    def on_write(self, log: DataFrame, last_seq: int) -> None:
        if last_seq - self._last(last_seq)[0] >= self.every:
            self.refresh(log, last_seq)

    def on_forget(self, log: DataFrame, last_seq: int) -> None:
        if self._last(last_seq)[1] is not None:
            self.refresh(log, last_seq, anew=True)


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        declared: dict[str, bool] | None = None,
        root_key: bytes | None = None,
        *,
        default_multi: bool = False,
        store: ports.EventStore | None = None,
        keyring: ports.Keyring | None = None,
        extractor: ports.Extractor | None = None,
        embedder: ports.Embedder | None = None,
        resolver: ports.EntityResolver | None = None,
        backend: ports.ProjectionBackend | None = None,
    ):
        """A store at `path`. With a root key contents are sealed and certificates signed; each port may be supplied."""
        self.spark, self.path, self.declared, self.root_key, self.default_multi = spark, path, declared, root_key, default_multi
        self.store = store or L.Log(spark, path)
        self.keyring = keyring or (FileKeyring(spark, f"{path}/keyring", root_key) if root_key else None)
        self.extractor, self.embedder = extractor or ports.RuleExtractor(), embedder
        self.resolver = resolver or ports.NameResolver()
        self.backend = backend or KeptFold(spark, f"{path}/fold", self.keyring)

    def __len__(self) -> int:
        return self.store.state().last_seq

    def close(self) -> None:
        """Nothing is held open; the session is the caller's."""

    def truncate(self) -> None:
        """Delete the store with its keys."""
        self.store.truncate()

    def stored(self) -> DataFrame:
        """The log as it lies on disk."""
        return self.store.table("log")

    def _readable(self, rows: DataFrame) -> DataFrame:
        """Contents opened; events of subjects without a key are skipped."""
        if self.keyring is None:
            return rows
        return erase.decrypt(rows, self.keyring.frame(), sealed=F.col("op").isin(S.EPISODE, S.ASSERTED))

    def log(self) -> DataFrame:
        return self._readable(self.stored())

    def entries(self) -> DataFrame:
        return self.store.table("audit")

    def _numbered(self, rows: DataFrame, last: int) -> DataFrame:
        """seq from last + 1 on in the order of __order: counts by range, then places within it."""
        ranged = rows.repartitionByRange("__order").sortWithinPartitions("__order")
        placed = materialise(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33)))
        before = placed.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__part")) - F.col("n"))  # a row for each task
        return placed.join(F.broadcast(before), "__part").withColumn("seq", F.col("__before") + F.col("__at") + 1 + last)

    def _few(self, rows: DataFrame, state) -> tuple[DataFrame, DataFrame, int, str]:
        """The rows of one message, numbered, and their links, by way of the driver: (rows, links, last number, head)."""
        ordered = rows.coalesce(1).sortWithinPartitions("__order").withColumn("seq", F.monotonically_increasing_id() + 1 + state.last_seq)
        times = [f.name for f in S.LOG if f.dataType == TimestampType()]
        whole = L.complete(ordered)
        exact = whole.select(*[F.unix_micros(c).alias(c) if c in times else c for c in whole.columns], event_ref().alias("__ref"), event_digest().alias("__hash")).collect()
        made, links, last, head = [], [], state.last_seq, state.head or GENESIS
        for r in exact:
            made.append(tuple(_EPOCH + datetime.timedelta(microseconds=r[c]) if c in times and r[c] is not None else r[c] for c in whole.columns))
            entry = hashlib.sha256((head + r["__hash"]).encode()).hexdigest()
            links.append((r.seq, r.op, r["__ref"], r["__hash"], head, entry))
            last, head = r.seq, entry
        one = lambda data, schema: self.spark.createDataFrame(data, schema).coalesce(1)
        return one(made, S.LOG), one(links, S.AUDIT), last, head

    def _many(self, rows: DataFrame, state) -> tuple[DataFrame, DataFrame, int, str]:
        """As _few for any number of rows: written, chained by one task that streams their hashes."""
        plain = materialise(L.complete(self._numbered(rows, state.last_seq)))
        links = materialise(audit.build_from(audit.payloads(plain), state.head or GENESIS))
        end = links.agg(F.max("seq").alias("s"), F.max_by("entry_hash", "seq").alias("h")).head()
        return plain, links, end.s or state.last_seq, end.h or state.head

    def _append(self, make, few: bool = True, **more: DataFrame) -> DataFrame:
        """Commit the rows that make(state) gives, with the chain's new links and rows of other tables.

        Rows are made anew where another writer was quicker. Returns them as committed.
        """
        for _ in range(ATTEMPTS):
            state = self.store.state()
            plain, links, last, head = (self._few if few else self._many)(make(state), state)
            stored = plain
            if self.keyring is not None:
                sealed = plain.where(F.col("op").isin(S.EPISODE, S.ASSERTED) & F.col("subject_id").isNotNull()).select("subject_id").distinct()
                if not few and hasattr(self.keyring, "issue"):
                    self.keyring.issue(sealed)
                else:
                    for r in sealed.toLocalIterator():
                        self.keyring.key_for(r.subject_id)
                stored = erase.encrypt(plain, self.keyring.frame())
            tables = {"log": [self.store.write("log", stored)], "audit": [self.store.write("audit", links)]}
            tables |= {name: [self.store.write(name, df)] for name, df in more.items()}
            if self.store.publish(state, tables, last, head):
                if state.number + 1 - state.since >= L.COMPACT_AFTER:
                    self.store.compact()
                self.backend.on_write(self.log(), last)
                return plain
        raise RuntimeError(f"no place in the log after {ATTEMPTS} attempts")

    def append(self, events: DataFrame) -> DataFrame:
        """Any number of events with an `op` and its columns, in the order of `__order`; returns them numbered."""
        return self._append(lambda state: events, few=False)

    def rebuild(self) -> None:
        """Fold the whole log again and keep the edges."""
        if isinstance(self.backend, KeptFold):
            self.backend.refresh(self.log(), len(self), anew=True)

    def edges(self, upto: int | None = None) -> DataFrame:
        """Edges of subjects that are not forgotten, with their place in the log.

        `upto` gives the state after that event; tombstones count whenever they came.
        """
        state = self.store.state()
        whole = self._readable(self.store.table("log", state))
        edges = self.backend.edges(whole, state.last_seq) if upto is None else project.fold(whole.where(F.col("seq") <= upto))
        return project.without_forgotten(edges, whole.where(F.col("op") == S.FORGOTTEN)).withColumnRenamed("pos", "seq")

    def add(
        self,
        text: str,
        subject_id: str | None = None,
        valid_from: str | None = None,
        source_ref: str | None = None,
        *,
        agent_id: str | None = None,
        session_id: str | None = None,
        org_id: str | None = None,
    ) -> list[str]:
        """Record one message: its episode, the facts in it, and what they supersede. Returns the ids of the new facts."""
        now, eid = datetime.datetime.now(datetime.UTC), uuid.uuid4().hex
        when = instant(valid_from) or now
        scope = {"subject_id": subject_id, "agent_id": agent_id, "session_id": session_id, "org_id": org_id}
        schema = f"op string, episode_id string, content_hash string, payload string, source_ref string, valid_from timestamp, recorded_at timestamp, {', '.join(f'{c} string' for c in scope)}"
        message = self.spark.createDataFrame([(S.EPISODE, eid, hashlib.sha256(text.encode()).hexdigest(), text, source_ref, when, now, *scope.values())], schema)
        found = materialise(ingest.cardinality(self.extractor.extract(message, "payload"), self.declared, self.default_multi))

        def make(state):
            live = self.edges().where("alive")
            order = F.col("rule") * 1_000_000 + F.col("pos")
            new = ingest.first_in_message(found.withColumn("seq", order)).join(live.select("subject", "predicate", "object"), ["subject", "predicate", "object"], "left_anti")
            span = F.when(F.col("span_lo").isNotNull() & F.col("span_hi").isNotNull(), F.struct(F.col("span_lo").alias("lo"), F.col("span_hi").alias("hi")))
            new = new.withColumn("fact_id", F.sha2(F.concat_ws("|", "episode_id", "rule", "pos"), 256)).withColumn("char_span", span)
            key = Window.partitionBy("subject", "predicate").orderBy("seq")
            latest = live.groupBy("subject", "predicate").agg(F.max_by("fact_id", "seq").alias("live_fact"))
            new = new.join(latest, ["subject", "predicate"], "left").withColumn("closes", F.when(~F.col("multi"), F.coalesce(F.lag("fact_id").over(key), F.col("live_fact"))))
            made = new.select(
                F.lit(S.ASSERTED).alias("op"),
                "episode_id",
                "fact_id",
                "subject",
                "predicate",
                "object",
                "valid_from",
                "confidence",
                "char_span",
                *scope,
                "recorded_at",
                (F.col("seq") * 2 + 2).alias("__order"),
            )
            gone = new.where("closes IS NOT NULL").select(
                F.lit(S.INVALIDATED).alias("op"),
                F.col("closes").alias("fact_id"),
                F.lit("superseded").alias("reason"),
                F.col("valid_from").alias("valid_to"),
                "recorded_at",
                (F.col("seq") * 2 + 1).alias("__order"),
            )
            episode = message.drop("valid_from").withColumn("__order", F.lit(-1))
            return episode.unionByName(gone, allowMissingColumns=True).unionByName(made, allowMissingColumns=True).coalesce(1)

        rows = self._append(make)
        return [r.fact_id for r in rows.where(F.col("op") == S.ASSERTED).orderBy("seq").select("fact_id").collect()]

    def search(self, query: str, subject_id: str | None = None, as_of: str | None = None, limit: int = 5) -> DataFrame:
        if limit < 1:
            raise ValueError("limit must be at least 1")
        e, at = self.edges(), instant(as_of)
        e = project.live(e, subject_id) if at is None else project.as_of(e, F.lit(at), subject_id)
        q = self.spark.createDataFrame([(1, query)], "query_id bigint, query string")
        return recall.rank(q, e, limit, embedder=self.embedder)

    def answer(self, query: str, subject_id: str | None = None, as_of: str | None = None) -> str | None:
        best = self.search(query, subject_id, as_of, 1).head()
        return best.object if best else None

    def timeline(self, subject_id: str | None = None, subject: str | None = None) -> DataFrame:
        """Edges in the order of validity, of a scope's subject, of an entity of that name, or of both."""
        e = self.edges()
        e = e if subject_id is None else e.where(F.col("subject_id") == subject_id)
        return history.timeline(e if subject is None else e.where(F.col("subject") == subject)).orderBy("subject", "place")

    def provenance(self, fact_id: str) -> DataFrame:
        facts = self.edges().where(F.col("fact_id") == fact_id).select("fact_id", "episode_id", F.col("char_span.lo").alias("span_lo"), F.col("char_span.hi").alias("span_hi"))
        return history.provenance(facts, self.log().where(F.col("op") == S.EPISODE))

    def conflicts(self) -> DataFrame:
        return history.conflicts(ingest.cardinality(self.edges(), self.declared, self.default_multi))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return history.graph_nodes(self.edges()), history.graph_edges(self.edges())

    def _entity_event(self, op: str, canonical: str, alias: str, evidence: str | None = None) -> None:
        now = datetime.datetime.now(datetime.UTC)
        self._append(lambda state: self.spark.createDataFrame(
            [(op, canonical, alias, evidence, now, 0)],
            "op string, canonical_id string, alias_id string, evidence string, recorded_at timestamp, __order int",
        ))

    def merge_entities(self, canonical: str, alias: str, evidence: str = "") -> None:
        self._entity_event(S.MERGED, canonical, alias, evidence)

    def unmerge_entities(self, canonical: str, alias: str) -> None:
        self._entity_event(S.UNMERGED, canonical, alias)

    def resolve_entities(self, names: list[str] | None = None, auto: bool = True) -> DataFrame:
        """Pairs of names (all of the edges', if none are given) with bands; with `auto` those of the automatic band are merged."""
        given = resolve.names_of(self.edges()) if names is None else self.spark.createDataFrame([(n,) for n in names], "name string")
        decided = materialise(self.resolver.resolve(given))
        merged = resolve.merges(decided)
        if auto and not merged.isEmpty():
            self.append(merged.withColumn("recorded_at", F.lit(datetime.datetime.now(datetime.UTC))).withColumn("__order", F.struct("canonical_id", "alias_id")))
        return decided

    def resolve(self) -> DataFrame:
        return project.alias_resolve(self.spark, project.alias_state(self.log()))

    def forget(self, subject_id: str, requested_by: str = "operator", dry_run: bool = False) -> dict:
        """Erase a subject: a tombstone and a certificate in one commit, then its key goes.

        The certificate's counts are those before; a dry run changes nothing and stays unsigned.
        """
        log, s = self.log(), self.spark.createDataFrame([(subject_id,)], "subject_id string")
        gone = log.where(F.col("op") == S.FORGOTTEN)
        episodes = project.without_forgotten(log.where(F.col("op") == S.EPISODE), gone)
        row = erase.preview(episodes.select("subject_id", "episode_id"), self.edges().select("subject_id", "fact_id"), s).head()
        now = datetime.datetime.now(datetime.UTC)
        cert = {"certificate_id": uuid.uuid4().hex, "subject_id": subject_id, "requested_by": requested_by, "episodes_deleted": row.episodes_deleted, "facts_deleted": row.facts_deleted, "manifest_hash": row.manifest_hash, "issued_us": int(now.timestamp() * 1e6), "dry_run": dry_run}
        if dry_run:
            return erase.sign(cert, None)
        signed = erase.sign(cert, self.root_key)
        kept = self.spark.createDataFrame([tuple(signed.get(f.name) if f.name != "issued_at" else now for f in S.CERTIFICATE)], S.CERTIFICATE)
        stone = self.spark.createDataFrame(
            [(S.FORGOTTEN, subject_id, requested_by, now, 0)],
            "op string, subject_id string, requested_by string, recorded_at timestamp, __order int",
        )
        self._append(lambda state: stone, certificate=kept)
        if self.keyring is not None:
            self.keyring.delete(subject_id)
        self.backend.on_forget(self.log(), len(self))
        return signed

    def certificates(self) -> DataFrame:
        """Certificates of the erasures so far, oldest first."""
        return self.store.table("certificate").orderBy("issued_at")

    def is_forgotten(self, subject_id: str) -> bool:
        return not self.log().where((F.col("op") == S.FORGOTTEN) & (F.col("subject_id") == subject_id)).isEmpty()

    def record_outcome(self, subject_id: str, deleted: bool, verified: bool | None) -> None:
        """What became of an erasure elsewhere, in a scope of its own, so that it outlives the subject; the id enters as a hash."""
        self.add(
            f"Erasure at the governed store: deleted={deleted}, verified={verified}.",
            agent_id="governed-store",
            source_ref=f"erasure:{hashlib.sha256(subject_id.encode()).hexdigest()[:16]}",
        )

    def erased_refs(self) -> DataFrame | None:
        """Ids of what was erased for good; None where nothing is sealed."""
        return None if self.keyring is None else audit.erased_refs(self.stored(), self.keyring.frame())

    def verify_audit(self, deep: bool = False):
        return (audit.verify_deep(self.log(), self.entries(), self.erased_refs()) if deep else audit.verify_links(self.entries())).head()

    def erasures(self) -> DataFrame:
        """The last request for each subject, checked again now, in the order of requests."""
        return erase.register(self.log().where(F.col("op") == S.FORGOTTEN), self.edges()).orderBy("recorded_at")

    def evidence(self, deep: bool = False):
        links = audit.verify_links(self.entries())
        if deep:
            links = audit.verify_deep(self.log(), self.entries(), self.erased_refs()).join(links.select("head"))  # two single rows
        return erase.evidence(links, self.erasures(), self.certificates()).head()
