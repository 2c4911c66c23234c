"""Erasure: what it would delete, its manifest and certificate, keys, and the evidence afterwards."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALGORITHM = "HMAC-SHA256"


def counts(episodes: DataFrame, edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject_id, episodes_deleted, facts_deleted) of each subject; superseded facts count. No ids are gathered."""
    ids = episodes.select("subject_id", F.lit(1).alias("e")).unionByName(edges.select("subject_id", F.lit(0).alias("e")))
    rows = subjects.select("subject_id").distinct().join(ids, "subject_id", "left")
    return rows.groupBy("subject_id").agg(F.count_if(F.col("e") == 1).alias("episodes_deleted"), F.count_if(F.col("e") == 0).alias("facts_deleted"))


def preview(episodes: DataFrame, edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject_id, episodes_deleted, facts_deleted, manifest_hash) of each subject; superseded facts count.

    The manifest is the SHA-256 of the sorted ids, joined by new lines, so a task holds the
    ids of one subject: about 40 bytes for each, which bounds a subject to some 50 million.
    """
    ids = episodes.select("subject_id", F.col("episode_id").alias("id")).unionByName(edges.select("subject_id", F.col("fact_id").alias("id")))
    asked = subjects.select("subject_id").distinct()
    listed = asked.join(ids, "subject_id", "left").groupBy("subject_id").agg(F.sort_array(F.collect_list("id")).alias("xs"))
    hashed = listed.select("subject_id", F.sha2(F.array_join("xs", "\n"), 256).alias("manifest_hash"))
    return counts(episodes, edges, asked).join(hashed, "subject_id")


def certificate_text(cert: dict, tag: str = "erasure-cert-v1") -> bytes:
    """What a signature commits to: a version tag and seven fields, piped; the time in microseconds."""
    fields = ("certificate_id", "subject_id", "requested_by", "episodes_deleted", "facts_deleted", "manifest_hash", "issued_us")
    return "|".join([tag, *(str(cert[f]) for f in fields)]).encode()


def sign(cert: dict, root_key: bytes | None) -> dict:
    """The certificate with its signature under a key derived from the root key; without one it stays unsigned."""
    if not root_key:
        return cert | {"signature": None, "algorithm": None}
    own = hmac.new(root_key, b"certificate", hashlib.sha256).digest()
    return cert | {"signature": base64.b64encode(hmac.new(own, certificate_text(cert), hashlib.sha256).digest()).decode(), "algorithm": ALGORITHM}


def verify(cert: dict, root_key: bytes) -> bool:
    if not cert.get("signature") or cert.get("algorithm") != ALGORITHM:
        return False
    return hmac.compare_digest(sign(cert, root_key)["signature"], cert["signature"])


class Keys:
    """Data keys by subject, held by the driver; shredding one makes its rows unreadable. sources.keyring has one that lasts."""

    def __init__(self, spark=None):
        self._keys: dict[str, bytes] = {}
        self.spark = spark

    def get(self, subject: str) -> bytes | None:
        return self._keys.get(subject)

    def put(self, subject: str, key: bytes) -> bytes:
        return self._keys.setdefault(subject, key)

    def key_for(self, subject: str) -> bytes:
        return self._keys.setdefault(subject, os.urandom(32))

    def delete(self, subject: str) -> bool:
        return self._keys.pop(subject, None) is not None

    shred = delete

    def keyring(self, spark, subjects=None) -> DataFrame:
        rows = [(s, k) for s, k in self._keys.items() if subjects is None or s in subjects]
        return spark.createDataFrame(rows, "subject_id string, key binary")

    def frame(self) -> DataFrame:
        return self.keyring(self.spark)


def encrypt(rows: DataFrame, keyring: DataFrame, columns: tuple[str, ...] = ("payload", "object")) -> DataFrame:
    """AES-GCM of the columns that hold content, under the subject's key; rows without a subject stay plain."""
    out = rows.join(keyring.select("subject_id", F.col("key").alias("__key")), "subject_id", "left")
    for c in columns:
        if c in rows.columns:
            out = out.withColumn(c, F.when(F.col("subject_id").isNull(), F.col(c)).otherwise(F.base64(F.aes_encrypt(F.col(c), F.col("__key"), F.lit("GCM")))))
    return out.drop("__key").select(*rows.columns)


def decrypt(rows: DataFrame, keyring: DataFrame, columns: tuple[str, ...] = ("payload", "object"), sealed=None) -> DataFrame:
    """Readable rows only: those of subjects without a key vanish.

    `sealed` (a condition) says which rows hold content; by default all of a subject. Others,
    such as tombstones, stay.
    """
    sealed = F.lit(True) if sealed is None else F.coalesce(sealed, F.lit(False))
    sealed = sealed & F.col("subject_id").isNotNull()
    out = rows.join(keyring.select("subject_id", F.col("key").alias("__key")), "subject_id", "left").where(~sealed | F.col("__key").isNotNull())
    for c in columns:
        if c in rows.columns:
            out = out.withColumn(c, F.when(sealed, F.try_aes_decrypt(F.unbase64(F.col(c)), F.col("__key"), F.lit("GCM")).cast("string")).otherwise(F.col(c)))
    return out.drop("__key").select(*rows.columns)


def register(tombstones: DataFrame, edges: DataFrame) -> DataFrame:
    """The last request for each subject, and how many of its facts are still there."""
    w = Window.partitionBy("subject_id").orderBy(F.desc("seq"))
    last = tombstones.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("subject_id", "requested_by", "recorded_at")
    left = edges.groupBy("subject_id").agg(F.count("*").alias("n"))
    return last.join(left, "subject_id", "left").select(
        "subject_id",
        "requested_by",
        "recorded_at",
        F.coalesce("n", F.lit(0)).alias("facts_left"),
        F.col("n").isNull().alias("erased"),
    )


def subject_check(subjects: DataFrame, tombstones: DataFrame, edges: DataFrame) -> DataFrame:
    """erased (a tombstone and no fact), incomplete (a tombstone and facts), or not erased."""
    t = tombstones.select("subject_id").distinct().withColumn("t", F.lit(True))
    n = edges.groupBy("subject_id").agg(F.count("*").alias("n"))
    out = subjects.select("subject_id").distinct().join(t, "subject_id", "left").join(n, "subject_id", "left")
    status = F.when(F.col("t").isNull(), "not erased").when(F.col("n").isNull(), "erased").otherwise("incomplete")
    return out.select("subject_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("facts_left"))


def evidence(chain: DataFrame, erasures: DataFrame, certificates: DataFrame | None = None) -> DataFrame:
    """One row: the chain's state, the erasures, how many certificates there are (null without a register), and whether all hold."""
    e = erasures.agg(F.count("*").alias("erasures"), F.coalesce(F.bool_and("erased"), F.lit(True)).alias("all_erased"))
    c = e.select(F.lit(None).cast("bigint").alias("certificates")) if certificates is None else certificates.agg(F.count("*").alias("certificates"))
    rows = chain.select(F.col("ok").alias("chain_ok"), "entries", "head").join(e).join(c)  # single rows
    return rows.select((F.col("chain_ok") & F.col("all_erased")).alias("ok"), "chain_ok", "entries", "head", "erasures", "certificates")


def evidence_markdown(row, erasures: list, certificates: list = ()) -> str:
    """The report of one collected row, the register of erasures and the certificates of them."""
    lines = ["# Evidence", "", f"- overall: {'ok' if row.ok else 'FAILED'}", f"- chain: {'ok' if row.chain_ok else 'broken'}, {row.entries} entries, head {row.head}"]
    lines += ["", "## Erasures", "", "| subject | requested by | at | facts left |", "|---|---|---|---|"]
    lines += [f"| {e.subject_id} | {e.requested_by} | {e.recorded_at} | {e.facts_left} |" for e in erasures] or ["| none | | | |"]
    lines += ["", "## Certificates", "", "| id | subject | episodes | facts | manifest | issued | signed |", "|---|---|---|---|---|---|---|"]
    lines += [f"| {c.certificate_id} | {c.subject_id} | {c.episodes_deleted} | {c.facts_deleted} | {c.manifest_hash} | {c.issued_at} | {c.algorithm or 'no'} |" for c in certificates] or ["| none | | | | | | |"]
    return "\n".join(lines) + "\n"
