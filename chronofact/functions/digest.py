"""Content digests of log events and links of the hash chain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

GENESIS = "0" * 64


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")).cast("string")


def _text(c) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _piped(*parts) -> Column:
    return sha(F.concat_ws("|", *[_text(p) for p in parts]))


def event_digest() -> Column:
    """The payload hash of a log row. Free text enters by its own hash, null as empty, times as microseconds."""
    scope = ("subject_id", "agent_id", "session_id", "org_id")
    # The order of fields in each layout.
    span = F.when(F.col("char_span").isNotNull(), F.concat_ws(",", F.col("char_span.lo").cast("string"), F.col("char_span.hi").cast("string")))
    confidence = F.col("confidence").cast("decimal(9,6)")
    recorded = micros(F.col("recorded_at"))
    layouts = {
        S.EPISODE: ("episode_id", "content_hash", sha(_text("source_ref")), *scope, recorded),
        S.ASSERTED: (
            "fact_id",
            "subject",
            "predicate",
            sha(_text("object")),
            micros(F.col("valid_from")),
            micros(F.col("valid_to")),
            confidence,
            span,
            "episode_id",
            *scope,
            recorded,
        ),
        S.INVALIDATED: ("fact_id", "reason", micros(F.col("valid_to")), "superseded_by", recorded),
        S.MERGED: ("canonical_id", "alias_id", sha(_text("evidence")), recorded),
        S.UNMERGED: ("canonical_id", "alias_id", recorded),
        S.FORGOTTEN: ("subject_id", "requested_by", recorded),
    }
    out = None
    for op, fields in layouts.items():
        one = _piped(F.lit(op), *fields)
        out = F.when(F.col("op") == op, one) if out is None else out.when(F.col("op") == op, one)
    return out


def event_ref() -> Column:
    return (
        F.when(F.col("op") == S.EPISODE, F.col("episode_id"))
        .when(F.col("op").isin(S.ASSERTED, S.INVALIDATED), F.col("fact_id"))
        .when(F.col("op").isin(S.MERGED, S.UNMERGED), F.col("canonical_id"))
        .otherwise(F.col("subject_id"))
    )


def link(prev: Column, payload_hash: Column) -> Column:
    return sha(F.concat(prev, payload_hash))
