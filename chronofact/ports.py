"""What the engine lets others supply: extractors, embedders, resolvers, stores, keyrings.

A port is a protocol over DataFrames, so that an implementation runs where the rows are.
"""

from __future__ import annotations

import hashlib
import importlib
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .functions.vector import DIM
from .operators import ingest, project, resolve
from .sources.keyring import Keyring

FOUND = "subject string, rule int, pos int, predicate string, object string, span_lo int, span_hi int, confidence double"


class Extractor(Protocol):
    """Messages (subject_id, a text) to one row for each fact, with the columns of FOUND beside the message's."""

    def extract(self, messages: DataFrame, text: str = "text") -> DataFrame: ...


class Embedder(Protocol):
    """Texts to unit vectors; `semantic` says whether they mean something or are hashes."""

    dim: int
    semantic: bool

    def column(self, text: Column) -> Column: ...


class EntityResolver(Protocol):
    """Names to (canonical_id, alias_id, score, band)."""

    def resolve(self, names: DataFrame) -> DataFrame: ...


class EventStore(Protocol):
    def table(self, name: str, state=None) -> DataFrame: ...
    def state(self): ...
    def write(self, name: str, rows: DataFrame) -> str: ...
    def read(self, name: str, folder: str) -> DataFrame: ...
    def publish(self, before, tables: dict[str, list[str]], last_seq: int, head: str | None, since: int | None = None) -> bool: ...
    def compact(self, least: int = 2) -> bool: ...
    def truncate(self) -> None: ...


class ProjectionBackend(Protocol):
    """The edges of a log that grows; told of writes and erasures."""

    def edges(self, log: DataFrame, last_seq: int) -> DataFrame: ...
    def on_write(self, log: DataFrame, last_seq: int) -> None: ...
    def on_forget(self, log: DataFrame, last_seq: int) -> None: ...


__all__ = ["EntityResolver", "Embedder", "EventStore", "Extractor", "FoldOnRead", "HashEmbedder", "Keyring", "ModelEmbedder", "ModelExtractor", "NameResolver", "ProjectionBackend", "ReplayExtractor", "Retry", "RuleExtractor", "default_embedder", "default_extractor"]


class RuleExtractor:
    """The built-in rules, as expressions."""

    def extract(self, messages: DataFrame, text: str = "text") -> DataFrame:
        return ingest.extract(messages, text).withColumn("confidence", F.lit(1.0))


def _first_span(text: Column, found: Column) -> tuple[Column, Column]:
    """The place of the first occurrence, or null for both ends."""
    at = F.instr(text, found)
    lo = F.when((at > 0) & (F.length(found) > 0), at - 1)
    return lo.cast("int"), (lo + F.length(found)).cast("int")


class ReplayExtractor:
    """Facts that were extracted before: rows (a key, pos, predicate, object[, subject, confidence]) joined to messages by the key."""

    def __init__(self, facts: DataFrame, key: str = "source_ref"):
        self.facts, self.key = facts, key

    def extract(self, messages: DataFrame, text: str = "text") -> DataFrame:
        have = self.facts.columns
        value = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
        f = self.facts.select(
            F.col(self.key).alias("__k"),
            "pos",
            "predicate",
            "object",
            value("subject", "string").alias("__s"),
            F.coalesce(value("confidence", "double"), F.lit(1.0)).alias("confidence"),
        )
        lo, hi = _first_span(F.col(text), F.col("object"))
        joined = messages.join(f, F.col(self.key) == F.col("__k"))
        return joined.select(
            *messages.columns,
            F.coalesce("__s", "subject_id", F.lit("subject")).alias("subject"),
            F.lit(0).alias("rule"),
            F.col("pos").cast("int").alias("pos"),
            "predicate",
            "object",
            lo.alias("span_lo"),
            hi.alias("span_hi"),
            "confidence",
        )


#: Answers of a service after which it is asked again, beside those from 500 on.
AGAIN = (408, 409, 429)


@dataclass
class Retry:
    """Ask again after connection errors and answers that promise better: waits double from `first` to `most` seconds, with some chance.

    An error's `status` and `retry_after` are looked at if it has them.
    """

    times: int = 8
    first: float = 2.0
    most: float = 60.0
    chance: float = 0.5
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    @staticmethod
    def worth(error: Exception) -> bool:
        status = getattr(error, "status", None)
        return isinstance(error, ConnectionError | TimeoutError) or (isinstance(status, int) and (status in AGAIN or status >= 500))

    def call(self, ask: Callable, *args):
        for n in range(self.times + 1):
            try:
                return ask(*args)
            except Exception as e:
                if n == self.times or not self.worth(e):
                    raise
                told = getattr(e, "retry_after", None)
                self.sleep(float(told) if told is not None else min(self.most, self.first * 2**n) + random.random() * self.chance)


def _ask_model(batches: Iterator[pa.RecordBatch], *, find: Callable, retry: Retry, text: int, scope: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, out = [], []
        for i, (t, s) in enumerate(zip(b.column(text).to_pylist(), b.column(scope).to_pylist(), strict=True)):
            for pos, (subject, predicate, value, confidence) in enumerate(retry.call(find, t) if t else []):
                lo = t.find(value) if value else -1
                row.append(i)
                out.append((subject or s or "subject", 0, pos, predicate, value, lo if lo >= 0 else None, lo + len(value) if lo >= 0 else None, confidence))
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, types, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(j).take(pa.array(row, pa.int64())) for j in range(b.num_columns)), *columns],
            names=[*b.schema.names, *(c.split()[0] for c in FOUND.split(", "))],
        )


class ModelExtractor:
    """A model behind a function text -> [(subject or None, predicate, object, confidence)], asked in the tasks, with retries."""

    def __init__(self, find: Callable, retry: Retry | None = None):
        self.find, self.retry = find, retry or Retry()

    def extract(self, messages: DataFrame, text: str = "text") -> DataFrame:
        schema = f"{', '.join(f'`{n}` {t}' for n, t in messages.dtypes)}, {FOUND}"
        run = partial(_ask_model, find=self.find, retry=self.retry, text=messages.columns.index(text), scope=messages.columns.index("subject_id"))
        return messages.mapInArrow(run, schema)


def _hash_rows(texts: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors of hashed tokens, a row for each text: each different token of the batch is hashed once."""
    tokens = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    of = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    flat = [w for x in tokens for w in x]
    out = np.zeros((len(tokens), dim))
    if flat:
        different, which = np.unique(np.array(flat), return_inverse=True)
        h = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in different.tolist()], np.uint64)[which]
        np.add.at(out, (of, (h % np.uint64(dim)).astype(int)), np.where(h >> np.uint64(1) & np.uint64(1), 1.0, -1.0))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


class HashEmbedder:
    """Hashed vectors as arrays. Recall has them as sparse columns and takes this one only if it is asked to."""

    semantic = False

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def column(self, text: Column) -> Column:
        dim = self.dim
        return F.pandas_udf(lambda texts: pd.Series(list(_hash_rows(texts, dim))), ArrayType(DoubleType()))(text)


class ModelEmbedder:
    """A model behind a function [texts] -> [vectors], asked by batches; vectors are normalised, null has zeros."""

    semantic = True

    def __init__(self, embed: Callable, dim: int):
        self.embed, self.dim = embed, dim

    def column(self, text: Column) -> Column:
        embed, dim = self.embed, self.dim

        def run(texts):
            out = np.zeros((len(texts), dim))
            filled = np.flatnonzero(texts.notna().to_numpy())
            if len(filled):
                out[filled] = np.asarray(embed(texts.iloc[filled].tolist()), float)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return pd.Series(list(np.divide(out, norm, out=out, where=norm > 0)))

        return F.pandas_udf(run, ArrayType(DoubleType()))(text)


class NameResolver:
    """The built-in score and bands."""

    def resolve(self, names: DataFrame) -> DataFrame:
        return resolve.bands(resolve.similar(names))


class FoldOnRead:
    """Edges folded from the whole log at each read."""

    def edges(self, log: DataFrame, last_seq: int) -> DataFrame:
        return project.fold(log)

    def on_write(self, log: DataFrame, last_seq: int) -> None:
        pass

    on_forget = on_write


def _named(environment: dict[str, str], name: str):
    """What a setting `module:function` names, called; None if it is unset or its module is not installed."""
    if not (text := environment.get(name)):
        return None
    module, _, function = text.partition(":")
    try:
        return getattr(importlib.import_module(module), function)()
    except ModuleNotFoundError:
        return None


def default_extractor(environment: dict[str, str]):
    """The extractor that CHRONOFACT_EXTRACTOR names (module:function), else the built-in rules."""
    return _named(environment, "CHRONOFACT_EXTRACTOR") or RuleExtractor()


def default_embedder(environment: dict[str, str]):
    """The embedder that CHRONOFACT_EMBEDDER names (module:function), else None: hashed vectors."""
    return _named(environment, "CHRONOFACT_EMBEDDER")
