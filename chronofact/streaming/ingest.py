"""The log as a stream: stateful supersession, incremental edges, windowed counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FACT = "seq long, fact_id string, subject string, predicate string, object string, valid_from timestamp"


#: Parts of the keys; those of one part are done in one call and share one state.
PARTS = 4096


def _changes(part, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Facts of one part's keys that change their key's value; state is the current value and its fact of each key, as JSON."""
    held = {(s, p): (now, fact) for s, p, now, fact in json.loads(state.get[0])} if state.exists else {}
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    places: dict[tuple, int] = {}
    plain = lambda values: (None if pd.isna(x) else x for x in values)
    codes = np.array([places.setdefault(k, len(places)) for k in zip(plain(rows["subject"]), plain(rows["predicate"]))], dtype=np.int64)
    known = list(places)
    place = codes.argsort(kind="stable")
    rows, codes = rows.iloc[place], codes[place]
    first = np.r_[True, codes[1:] != codes[:-1]] if len(rows) else np.zeros(0, bool)
    start = [held.get(k, (None, None)) for k in known]

    def before(values: pd.Series, begin: list) -> pd.Series:
        out = values.astype(object).shift(1).to_numpy(copy=True)
        out[first] = [begin[c] for c in codes[first]]
        return pd.Series(out, index=values.index, dtype=object)

    # A fact changes the value if the one before it, in the order of arrival, had another.
    changed = rows["object"].astype(object).ne(before(rows["object"], [x[0] for x in start])).to_numpy()
    out, codes = rows[changed].copy(), codes[changed]
    first = np.r_[True, codes[1:] != codes[:-1]] if len(out) else np.zeros(0, bool)
    out["closes"] = before(out["fact_id"], [x[1] for x in start])
    last = np.r_[first[1:], True] if len(out) else first
    held |= {known[c]: (now, fact) for c, now, fact in zip(codes[last], out["object"][last], out["fact_id"][last])}
    state.update((json.dumps([[*k, *plain(v)] for k, v in held.items()]),))
    yield out[["seq", "fact_id", "subject", "predicate", "object", "valid_from", "closes"]]


def supersede(stream: DataFrame) -> DataFrame:
    """Change events of single-valued keys; `closes` is the fact that ends. Arrival order counts, nothing is late.

    Keys are dealt into PARTS, as a call in Python costs more than the rows of a key.
    """
    dealt = stream.withColumn("part", F.pmod(F.xxhash64("subject", "predicate"), F.lit(PARTS)))
    return dealt.groupBy("part").applyInPandasWithState(_changes, FACT + ", closes string", "held string", "append", GroupStateTimeout.NoTimeout)


def upsert_edges(changes: DataFrame, path: str):
    """A foreachBatch writer: each batch's change events, once for each batch id, for edges_of to fold."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # a repeated batch replaces itself

    return changes.writeStream.foreachBatch(write)


def edges_of(spark, path: str) -> DataFrame:
    """The edge table of all batches so far: a fact is closed by the event that names it."""
    rows = spark.read.schema(FACT + ", closes string, batch int").parquet(path)
    ends = rows.where("closes IS NOT NULL").groupBy("closes").agg(F.min("valid_from").alias("valid_to"))
    return rows.drop("closes", "batch").join(ends, F.col("fact_id") == F.col("closes"), "left").drop("closes")


def window_counts(stream: DataFrame, time: str, key: str, size: str = "7 days", late: str = "1 day") -> DataFrame:
    """Tumbling counts by key; a window is final when the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
