"""Byte-level BPE by a local rank file: encoding of whole texts, and raw-byte decoding."""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows
from .tokenise import rank_encoding, safe_pieces

#: Characters of a text that the library gets at once, cut at safe boundaries.
PIECE_CHARS = 50_000


def encode_ids(text: str, path: str, pattern: str, piece_chars: int = PIECE_CHARS) -> list[int]:
    encoding = rank_encoding(path, pattern)
    out: list[int] = []
    for piece in safe_pieces(text, piece_chars):
        out += encoding.encode_ordinary(piece)
    return out


def decode_bytes(ids: list[int], path: str, pattern: str) -> bytes:
    """The bytes that the ids stand for, also where they are not valid UTF-8."""
    return rank_encoding(path, pattern).decode_bytes(ids)


def _encode(doc_id: pa.Array, text: pa.Array, path: str, pattern: str):
    return doc_id, [encode_ids(x or "", path, pattern) for x in text.to_pylist()]


def _decode(doc_id: pa.Array, ids: pa.Array, path: str, pattern: str):
    return doc_id, [decode_bytes(x or [], path, pattern) for x in ids.to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>); null and empty texts give an empty array, repeated rows repeat."""
    from .common import by_row

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return docs.select("doc_id", "text").mapInArrow(partial(by_row, make=partial(_encode, path=path, pattern=pattern), schema=schema), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids); null ids count as none."""
    return map_rows(encoded.select("doc_id", "ids"), partial(_decode, path=path, pattern=pattern), [("doc_id", pa.int64()), ("bytes", pa.binary())])


def _digest(doc_id: pa.Array, text: pa.Array, path: str, pattern: str):
    n, ids_sha, decoded_sha = [], [], []
    for x in text.to_pylist():
        ids = encode_ids(x or "", path, pattern)
        n.append(len(ids))
        ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        decoded_sha.append(hashlib.sha256(decode_bytes(ids, path, pattern)).hexdigest())
    return doc_id, n, ids_sha, decoded_sha


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each row the number of ids, their SHA-256 and that of the decoded bytes.

    A map without a shuffle, so no key can be hot. Null and empty texts have no id;
    repeated rows repeat; an empty table gives no row; other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return map_rows(docs.select("doc_id", "text"), partial(_digest, path=path, pattern=pattern), fields)
