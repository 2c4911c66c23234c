"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
all but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers

from chronofact.llm import exact_dedup, packing, secrets, simhash, toxicity
from chronofact.llm.common import materialise, table


def drop_toxic(spark, docs, sf_dir):
    """Rows that the classifier marks as toxic go; it learns from the labelled rows of the raw documents.

    Null and empty texts score 0 and stay, repeated rows share their fate, and without labels all stay.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.learnable())
    return toxicity.reject(docs, model)


def drop_copies(spark, docs, sf_dir):
    """Of rows with equal text the one with the smallest doc_id stays.

    Null counts as the empty text, a null doc_id comes after all others; of repeated rows one stays.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of each near-duplicate group the document with the smallest doc_id stays.

    Texts without a word form one group, null texts among them; a null doc_id stays only
    where no other is in its group.
    """
    return simhash.deduplicate(docs)


def mask_secrets(spark, docs, sf_dir):
    """Found secrets are masked in the texts; all rows stay, and those without a finding, null and empty ones too, are unchanged."""
    return secrets.redact(docs)


def pack(spark, docs, sf_dir):
    """Pieces of all documents in sequences of at most 1024 tokens; null and empty texts hold the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]

#: A trained classifier and the tokenizer are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`; what each returns is written and read again as the next one's input. An empty table gives no piece."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
