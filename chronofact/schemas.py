"""The event log: one wide, append-only table; `op` says which columns count."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

SCOPE = StructType([StructField(n, StringType()) for n in ("subject_id", "agent_id", "session_id", "org_id")])
SPAN = StructType([StructField("lo", IntegerType()), StructField("hi", IntegerType())])

LOG = StructType(
    [
        StructField("seq", LongType(), False),
        StructField("op", StringType(), False),
        StructField("episode_id", StringType()),
        StructField("content_hash", StringType()),
        StructField("payload", StringType()),
        StructField("source_ref", StringType()),
        StructField("fact_id", StringType()),
        StructField("subject", StringType()),
        StructField("predicate", StringType()),
        StructField("object", StringType()),
        StructField("valid_from", TimestampType()),
        StructField("valid_to", TimestampType()),
        StructField("confidence", DoubleType()),
        StructField("char_span", SPAN),
        StructField("reason", StringType()),
        StructField("superseded_by", StringType()),
        StructField("canonical_id", StringType()),
        StructField("alias_id", StringType()),
        StructField("evidence", StringType()),
        StructField("requested_by", StringType()),
        StructField("subject_id", StringType()),
        StructField("agent_id", StringType()),
        StructField("session_id", StringType()),
        StructField("org_id", StringType()),
        StructField("recorded_at", TimestampType()),
    ]
)

EPISODE, ASSERTED, INVALIDATED = "episode", "asserted", "invalidated"
MERGED, UNMERGED, FORGOTTEN = "entity_merged", "entity_unmerged", "subject_forgotten"

AUDIT = StructType([StructField("seq", LongType(), False), *[StructField(n, StringType()) for n in ("kind", "ref", "payload_hash", "prev_hash", "entry_hash")]])

CERTIFICATE = StructType(
    [
        *[StructField(n, StringType()) for n in ("certificate_id", "subject_id", "requested_by")],
        StructField("episodes_deleted", LongType()),
        StructField("facts_deleted", LongType()),
        StructField("manifest_hash", StringType()),
        StructField("issued_at", TimestampType()),
        StructField("signature", StringType()),
        StructField("algorithm", StringType()),
        StructField("dry_run", BooleanType()),
    ]
)

KEYRING = StructType([StructField("subject_id", StringType()), StructField("wrapped", BinaryType())])

ENTITY = StructType([StructField("canonical_id", StringType()), StructField("aliases", ArrayType(StringType()))])

EDGE = StructType(
    [
        *[StructField(n, StringType()) for n in ("fact_id", "subject", "predicate", "object")],
        *[StructField(n, TimestampType()) for n in ("valid_from", "valid_to", "tx_from", "tx_to")],
        StructField("confidence", DoubleType()),
        StructField("episode_id", StringType()),
        StructField("char_span", SPAN),
        StructField("subject_id", StringType()),
        StructField("pos", LongType()),
        StructField("alive", BooleanType()),
    ]
)

#: The fold of the log up to a number, as it is kept: the last assertion, its place, the last invalidation.
FOLD = StructType(
    [
        StructField("fact_id", StringType()),
        StructField("pos", LongType()),
        StructField("asserted_at", LongType()),
        *[f for f in LOG if f.name in ("subject", "predicate", "object", "valid_from", "valid_to", "confidence", "episode_id", "char_span", "subject_id", "recorded_at")],
        StructField("gone_at", LongType()),
        StructField("gone_to", TimestampType()),
        StructField("gone_recorded", TimestampType()),
    ]
)
