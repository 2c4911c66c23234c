"""The subpackage's queries, one for each operator, over whole tables, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, exact_dedup, language_id, packing, rank_bpe, secrets, simhash, suffix_dedup, token_files, toxicity
from .common import crc_mod, keep_until_end, shared_dir, table


def op1_packing(spark, sf_dir):
    """Pieces of all documents in sequences of at most 1024 tokens. Null and empty texts hold the end id alone; an empty table gives no row."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_exact_dedup(spark, sf_dir):
    """Each document with its group of equal texts. Null texts are empty; repeated rows count each; an empty table gives no row."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    """Each document with the language of its whole text; `und` and 0 for null and letterless ones. A null doc_id is not held out and is never learned from."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs, language_id.learnable()))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_suffix_dedup(spark, sf_dir):
    """Each document without the bytes of 400-byte strings that start twice or more. Null texts are empty; a repeated row repeats all its strings."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    """Each document with its score; null and empty texts score 0. A null doc_id is not held out and is never learned from."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ann(spark, sf_dir):
    """The five nearest vectors of every fiftieth one; vectors null, zero or not finite take no part; few rows give fewer neighbours."""
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op7_secrets(spark, sf_dir):
    """Each document with the secrets in it; null and empty texts have none, repeated rows repeat."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op8_rank_bpe(spark, sf_dir):
    """Each document encoded by ranks and decoded again; null texts are empty."""
    return rank_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_files(spark, sf_dir):
    """Each document as read back from token files, which go when the driver ends; null texts hold the end id alone, null ids come first."""
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    keep_until_end(spark, path)
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(spark, path)


def op10_simhash(spark, sf_dir):
    """Each document with its fingerprint and component; texts without a word have fingerprint zero; a null doc_id names no component."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_packing,
    op2_exact_dedup,
    op3_language_id,
    op4_suffix_dedup,
    op5_toxicity,
    op6_ann,
    op7_secrets,
    op8_rank_bpe,
    op9_token_files,
    op10_simhash,
)}

ORACLE = {
    "op2_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)""",
}
