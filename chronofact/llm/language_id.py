"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes is counted once and then frozen: order
three at most, with escapes to shorter contexts (method C: of n bytes seen after a
context, k of them different, a new one has k / (n + k)). As statistics are frozen,
the code length of a byte depends on the three bytes before it alone; before a text's
start stand zero bytes. Trees are kept sparse, as the strings of up to four bytes that a
language has shown and their counts. To score, a few languages at a time are laid into
tables, a row for each string that any of them has shown, and whole texts are looked up.
"""

from __future__ import annotations

import pickle
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_rows, materialise
from .toxicity import _Held

#: About so many documents of each language are counted, chosen by the hash of their ids.
SAMPLE_DOCS = 400
ORDER = 3
#: Languages that are laid into one set of tables.
TOGETHER = 8
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 20


def _strings(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ORDER + 1 bytes that end at each place as one number; before a text's start stand zeros."""
    at = np.arange(len(b), dtype=np.int32) - np.repeat(starts, np.diff(np.append(starts, len(b)))).astype(np.int32)
    out = b.astype(np.uint32)
    for back in range(1, ORDER + 1):
        before = np.concatenate([np.zeros(min(back, len(b)), np.uint32), b[: max(0, len(b) - back)].astype(np.uint32)])
        out |= np.where(at >= back, before, np.uint32(0)) << np.uint32(8 * back)
    return out


def _last(strings: np.ndarray, m: int) -> np.ndarray:
    return strings & np.uint32((1 << 8 * m) - 1)


def tree(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to ORDER + 1 the strings that the texts show, ascending, and how often."""
    texts = [x for x in texts if x]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    seen = _strings(np.frombuffer(b"".join(texts), np.uint8), starts) if texts else np.zeros(0, np.uint32)
    return [np.unique(_last(seen, m), return_counts=True) for m in range(1, ORDER + 2)]


def fit(texts: list[str | None], langs: list[str]) -> dict:
    """The frozen trees of the languages in `langs`, which are in alphabetical order."""
    names, own = sorted(set(langs)), {}
    for text, lang in zip(texts, langs, strict=True):
        own.setdefault(lang, []).append((text or "").encode("utf-8", "surrogatepass"))
    return _model({name: tree(own[name]) for name in names})


def _model(trees: dict[str, list]) -> dict:
    names = sorted(trees)
    return {"names": names, "k": 256, "symbol": np.arange(256), "trees": [trees[x] for x in names]}


def _tables(trees: list) -> list[tuple]:
    """By string length: (strings, bits of the last byte after the rest for each language, contexts, bits of leaving them).

    The bits of a string are exact for a language whether or not it has shown it; leaving a
    context that the language has not shown costs nothing.
    """
    out, shorter = [], None
    for m in range(1, ORDER + 2):
        strings = np.arange(256, dtype=np.uint32) if m == 1 else np.unique(np.concatenate([t[m - 1][0] for t in trees]))
        contexts = np.unique(strings >> np.uint32(8))
        bits, leave = np.zeros((len(strings), len(trees)), np.float32), np.zeros((len(contexts), len(trees)), np.float32)
        at = np.searchsorted(contexts, strings >> np.uint32(8))
        for i, t in enumerate(trees):
            shown, times = t[m - 1]
            own = np.searchsorted(contexts, shown >> np.uint32(8))
            n, different = np.bincount(own, times, len(contexts)), np.bincount(own, minlength=len(contexts))
            known = n > 0
            leave[known, i] = np.log2((n + different)[known] / different[known])
            before = 8.0 if m == 1 else shorter[1][np.searchsorted(shorter[0], _last(strings, m - 1)), i]
            bits[:, i] = leave[at, i] + before
            bits[np.searchsorted(strings, shown), i] = np.log2((n + different)[own] / times)
        shorter = (strings, bits)
        out.append((strings, bits, contexts, leave))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted key."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _bits(tables: list[tuple], strings: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each string under each language: by the longest ending that any language has shown."""
    keys, table, _, _ = tables[ORDER]
    at, there = _find(keys, strings)
    out = table[at] if len(table) else np.zeros((len(strings), table.shape[1]), np.float32)
    left = np.flatnonzero(~there)
    out[left] = 0
    for m in range(ORDER, -1, -1):
        if not len(left):
            break
        _, _, contexts, leave = tables[m]
        at, there = _find(contexts, _last(strings[left] >> np.uint32(8), m))
        out[left[there]] += leave[at[there]]
        if m == 0:
            break
        keys, table, _, _ = tables[m - 1]
        at, there = _find(keys, _last(strings[left], m))
        out[left[there]] += table[at[there]]
        left = left[~there]
    return out


def code_lengths(model: dict, texts: list[bytes], chunk: int = _CHUNK) -> np.ndarray:
    """Bits of each whole text under each language, shape (texts, languages); about `chunk` bytes are looked up at once."""
    out = np.zeros((len(texts), len(model["names"])))
    if "tables" not in model:
        model["tables"] = [(lo, _tables(model["trees"][lo : lo + TOGETHER])) for lo in range(0, len(model["names"]), TOGETHER)]
    lo = 0
    while lo < len(texts):  # short texts go together
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= chunk):
            size += len(texts[hi])
            hi += 1
        if size > chunk:  # one long text, in parts that begin with the context of their first byte
            for at in range(0, size, chunk):
                before = min(ORDER, at)
                part = np.frombuffer(texts[lo][at - before : at + chunk], np.uint8)
                strings = _strings(part, np.zeros(1, np.int64))[before:]
                for first, tables in model["tables"]:
                    found = _bits(tables, strings)
                    out[lo, first : first + found.shape[1]] += found.sum(0, dtype=np.float64)
        elif filled := [i for i in range(lo, hi) if texts[i]]:
            starts = np.cumsum([0, *(len(texts[i]) for i in filled)])[:-1]
            strings = _strings(np.frombuffer(b"".join(texts[i] for i in filled), np.uint8), starts)
            for first, tables in model["tables"]:
                found = _bits(tables, strings)
                out[filled, first : first + found.shape[1]] = np.add.reduceat(found, starts, axis=0, dtype=np.float64)
        lo = hi
    return out


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its posterior probability, all languages being equally likely before.

    `und` and 0 for null, for a text without a letter, and where nothing was learned; of
    languages with equal code lengths the first in alphabetical order.
    """
    names = model["names"]
    if not names:
        return ["und"] * len(texts), [0.0] * len(texts)
    bits = code_lengths(model, [(t or "").encode("utf-8", "surrogatepass") for t in texts])
    best = bits.argmin(1)
    share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
    lettered = [bool(t and _LETTER.search(t)) for t in texts]
    return [names[i] if x else "und" for i, x in zip(best, lettered, strict=True)], [float(p) if x else 0.0 for p, x in zip(share, lettered, strict=True)]


def _pack(model: dict) -> bytes:
    return pickle.dumps({k: v for k, v in model.items() if k != "tables"})


def _fit_language(rows: pa.Table) -> pa.Table:
    texts = [(x or "").encode("utf-8", "surrogatepass") for x in rows.column("text").to_pylist()]
    return pa.table({"lang": rows.column("lang").slice(0, 1), "tree": pa.array([pickle.dumps(tree(texts))], pa.binary())})


def train(docs: DataFrame, learn, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A tree from about sample_docs rows of each language for which `learn` holds; rows without text or language are left out.

    There is no bound on languages: a task fits one tree, and the driver holds one tree of
    bounded size for each language.
    """
    rows = docs.where(learn).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    # Written, so that its size is known to the planner, which broadcasts it only below its threshold.
    counts = materialise(rows.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__n")), "languages")
    share = F.lit(sample_docs * 1_000_000.0) / F.col("__n")
    sample = rows.join(counts, F.col("lang") == F.col("__lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    found = sample.select("lang", "text").groupBy("lang").applyInArrow(_fit_language, "lang string, tree binary").collect()
    return _pack(_model({r.lang: pickle.loads(bytes(r.tree)) for r in found}))


_models: dict[int, dict] = {}


def _predict(doc_id: pa.Array, text: pa.Array, held):
    if held.id not in _models:
        _models.clear()
        _models[held.id] = pickle.loads(held.value)
    return doc_id, *predict(_models[held.id], text.to_pylist())


def identify(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, lang_pred, score) for each row, from its whole text alone; repeated rows repeat, an empty table gives no row."""
    held = _Held(docs.sparkSession, model)
    return map_rows(docs.select("doc_id", "text"), partial(_predict, held=held), [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())], rows=500)


def learnable(column: str = "doc_id"):
    return crc_mod(column, 4) != 2
