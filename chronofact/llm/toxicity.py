"""Toxicity by multiple-instance learning: sentences scored, joined by noisy-or, trained from document labels.

A word is seen by its whole form and its beginnings, runs of a script without blanks
also by their pairs and triples of letters. Features are hashed into BUCKETS weights
of either sign, so no word is too short, too long or too rare to have one.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_rows

#: The classifier is fitted on at most so many labelled documents, those with the smallest hashes of their ids.
SAMPLE_DOCS = 20_000
BUCKETS = 1 << 20
#: Beginnings of words that are features beside the whole word.
PREFIXES = (2, 3, 4, 5, 6, 7, 8)
#: A bucket is learned if its log odds are farther from 0 than this share of the largest deviation that
#: chance alone is likely to give among all buckets seen: the square root of 2 log(buckets) standard deviations.
CERTAIN = 0.7
ROUNDS = 150
#: Words that are counted at once.
AT_ONCE = 1 << 18
CACHE_WORDS = 200_000
_SENTENCE = re.compile(r"[^.!?\n。！？]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts that are written without blanks between words: Thai to Myanmar, Khmer, kana, han.
_UNPARTED = re.compile("[฀-႟ក-៿぀-ヿ㐀-鿿\U00020000-\U0003ffff]")


def _buckets(word: str) -> list[int]:
    """Different buckets of a lower-case word, ascending."""
    found = ["=" + word, *["^" + word[:k] for k in PREFIXES if len(word) > k]]
    if not word.isascii() and _UNPARTED.search(word):
        found += ["~" + word[i : i + k] for k in (1, 2, 3) for i in range(len(word) - k + 1)]
    return sorted({xxhash.xxh64_intdigest(f) % BUCKETS for f in found})


class _Sample:
    """Labelled texts as numbers: only the different words of each sentence are held, not the texts."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.words, self.sizes, self.sentences, self.labels = (array("i") for _ in range(4))

    def add(self, text: str | None, label: int) -> None:
        n = 0
        for s in _SENTENCE.findall((text or "").lower()):
            if found := sorted({self.names.setdefault(w, len(self.names)) for w in _WORD.findall(s)}):
                self.words.extend(found)
                self.sizes.append(len(found))
                n += 1
        self.sentences.append(n)
        self.labels.append(int(bool(label)))

    def fit(self) -> dict:
        """{bias, weights}: a document's probability is 1 - prod(1 - p(sentence)); by gradient ascent on the labels.

        Sentences without a word that speaks for toxic count as clean, however many there are.
        Without both labels no weight is learned and every score is that of the empty text.
        """
        y, n_docs = np.array(self.labels, float), len(self.labels)
        none = {"bias": -3.0, "weights": np.zeros(BUCKETS, np.float32)}
        if not self.words or not y.any() or y.all():
            return none
        word, doc = np.array(self.words), np.repeat(np.arange(n_docs, dtype=np.int32), self.sentences)
        sent = np.repeat(np.arange(len(doc), dtype=np.int32), self.sizes)
        n_words, bucket, count = len(self.names), array("i"), array("i")
        for w in self.names:
            bucket.extend(own := _buckets(w))
            count.append(len(own))
        bucket, count = np.array(bucket), np.array(count)
        owner, first = np.repeat(np.arange(n_words, dtype=np.int32), count), np.concatenate([[0], np.cumsum(count)])
        # Documents of either label that have a bucket: each counts once. Some documents at a time.
        seen, ends = np.zeros((2, BUCKETS)), np.searchsorted(sent, np.searchsorted(doc, np.arange(n_docs + 1)))
        lo = 0
        while lo < n_docs:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + AT_ONCE, side="right")) - 1)
            own = slice(ends[lo], ends[hi])
            in_doc, in_word = np.divmod(np.unique(doc[sent[own]].astype(np.int64) * n_words + word[own]), n_words)
            size = count[in_word]
            at = np.repeat(first[in_word] - np.cumsum(size) + size, size) + np.arange(size.sum())
            once = np.unique(np.repeat(in_doc, size) * BUCKETS + bucket[at])
            for label in (0, 1):
                seen[label] += np.bincount(once[y[once // BUCKETS] == label] % BUCKETS, minlength=BUCKETS)
            lo = hi
        total = np.array([n_docs - y.sum(), y.sum()])[:, None]
        odds = np.diff(np.log((seen + 0.5) / (total + 1)), axis=0)[0]
        spread = np.sqrt((1 / (seen + 0.5)).sum(0))
        chance = CERTAIN * math.sqrt(2 * math.log(max(2, np.count_nonzero(seen.any(0)))))
        weight = np.sign(odds) * np.maximum(np.abs(odds) - chance * spread, 0) / 2
        active = np.flatnonzero(weight)
        number = np.full(BUCKETS, -1)
        number[active] = np.arange(len(active))
        live = number[bucket] >= 0
        owner, feat = owner[live], number[bucket[live]]
        known, speaks = np.zeros((2, n_words), bool)
        known[owner] = True
        speaks[owner[weight[active][feat] > 0]] = True
        shown = np.zeros(len(doc), bool)
        shown[sent[speaks[word]]] = True
        held = known[word] & shown[sent]
        word, sent = word[held], sent[held]
        if not len(word):
            return none
        shown, sent = np.unique(sent, return_inverse=True)
        doc, n_sent = doc[shown], len(shown)
        w, bias = weight[active], -3.0
        g2, gb2 = np.full(len(w), 1e-8), 1e-8
        for _ in range(ROUNDS):
            of_word = np.bincount(owner, w[feat], n_words)
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sent, of_word[word], n_sent), -30, 30)))
            gz = p * _pull(p, doc, y)[doc] / n_docs
            gw = np.bincount(feat, np.bincount(word, gz[sent], n_words)[owner], len(w)) - 1e-5 * w
            gb = gz.sum()
            g2, gb2 = g2 + gw**2, gb2 + gb**2
            w, bias = w + 0.1 * gw / np.sqrt(g2), bias + 0.1 * gb / math.sqrt(gb2)
        weights = np.zeros(BUCKETS, np.float32)
        weights[active] = w
        return {"bias": float(bias), "weights": weights}


def _pull(p: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By document, what the log-likelihood's derivative is to a sentence's p: (1 - P) / P where toxic, -1 where clean."""
    clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))  # log of the product
    return np.where(y > 0, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), -1.0)


def fit(texts: list[str | None], toxic: list[int]) -> dict:
    """A model of labelled texts, see _Sample.fit."""
    sample = _Sample()
    for text, label in zip(texts, toxic, strict=True):
        sample.add(text, label)
    return sample.fit()


class Scorer:
    def __init__(self, model: dict):
        self.bias, self.weights = model["bias"], model["weights"]
        self.active = {int(i): float(self.weights[i]) for i in np.flatnonzero(self.weights)}
        self.words: dict[str, tuple[float, bool] | None] = {}
        #: Beginnings of words: the bucket, or -1 where it has no weight.
        self.beginnings: dict[str, int] = {}

    def _active(self, word: str) -> set[int]:
        """Those of _buckets(word) that have a weight; beginnings are looked up, as words share them."""
        if not word.isascii() and _UNPARTED.search(word):
            return {b for b in _buckets(word) if b in self.active}
        found, held = {xxhash.xxh64_intdigest("=" + word) % BUCKETS}, self.beginnings
        for k in PREFIXES:
            if k >= len(word):
                break
            if (b := held.get(x := word[:k])) is None:
                if len(held) > CACHE_WORDS:
                    held.clear()
                b = xxhash.xxh64_intdigest("^" + x) % BUCKETS
                b = held[x] = b if b in self.active else -1
            found.add(b)
        return found & self.active.keys()

    def _known(self, word: str) -> tuple[float, bool] | None:
        """The word's sum of weights and whether one speaks for toxic; None if all of them are zero."""
        own = [self.active[b] for b in self._active(word)]
        return (math.fsum(own), max(own) > 0) if own else None

    def sentences(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """(start, end, probability) of the sentences with a word that speaks for toxic; places are in the text's characters."""
        for s in _SENTENCE.finditer(text or ""):
            found = []
            for w in set(_WORD.findall(s.group().lower())):
                if w not in self.words:
                    if len(self.words) > CACHE_WORDS:
                        self.words.clear()
                    self.words[w] = self._known(w)
                if (x := self.words[w]) is not None:
                    found.append(x)
            if any(speaks for _, speaks in found):
                z = self.bias + math.fsum(w for w, _ in found)
                yield s.start(), s.end(), 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str | None) -> float:
        clean = 1.0
        for _, _, p in self.sentences(text):
            clean *= 1 - p
        return 1 - clean


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sample = _Sample()
    for b in batches:
        for text, toxic in zip(b.column(1), b.column(2), strict=True):
            sample.add(text.as_py(), toxic.as_py())
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sample.fit())], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, learn, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Fit on at most sample_docs labelled rows for which `learn` (a condition on doc_id) holds.

    A doc_id labelled more than once is toxic if one row says so; null labels and ids are left out.
    """
    ids = labels.where(learn).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Bounded by the parameter: ids and labels only, so the side may be broadcast.
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").repartition(1).sortWithinPartitions("doc_id", "text")
    rows = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_fit_rows, "model binary").collect()
    return pickle.loads(bytes(rows[0].model)) if rows else fit([], [])


_scorers: dict[int, tuple] = {}


def _scorer(held) -> Scorer:
    if held.id not in _scorers:
        _scorers.clear()
        _scorers[held.id] = Scorer(held.value)
    return _scorers[held.id]


class _Held:
    """A broadcast model with a number that worker processes know it by."""

    def __init__(self, spark, model):
        self.sent = spark.sparkContext.broadcast(model)
        self.id = self.sent._jbroadcast.id() if hasattr(self.sent, "_jbroadcast") else id(self.sent)

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self):
        return self.sent.value


def _score(doc_id: pa.Array, text: pa.Array, held):
    scorer = _scorer(held)
    return doc_id, [scorer.score(x) for x in text.to_pylist()]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of each row, from the text alone. Null and empty texts score 0; repeated rows repeat."""
    held = _Held(docs.sparkSession, model)
    return map_rows(docs.select("doc_id", "text"), partial(_score, held=held), [("doc_id", pa.int64()), ("score", pa.float64())])


def _locate(doc_id: pa.Array, text: pa.Array, held, threshold: float):
    scorer, out = _scorer(held), []
    for d, t in zip(doc_id.to_pylist(), text.to_pylist(), strict=True):
        out += [(d, a, b, p, t[a:b]) for a, b, p in scorer.sentences(t) if p >= threshold]
    return list(zip(*out, strict=True)) if out else [[]] * 5


def offending_sentences(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, probability, sentence) of each sentence at the threshold or above; none for null or empty texts."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("sentence", pa.string())]
    return map_rows(docs.select("doc_id", "text"), partial(_locate, held=_Held(docs.sparkSession, model), threshold=threshold), fields)


def _clean_rows(batches: Iterator[pa.RecordBatch], *, held, threshold: float) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(held)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            yield part.filter(pa.array([scorer.score(x) < threshold for x in part.column("text").to_pylist()], pa.bool_()))


def reject(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score `threshold` or more; all columns stay, nothing is shuffled.

    Null and empty texts score 0 and stay (at a threshold over 0); repeated rows share their
    fate, as do rows of one doc_id by their own texts; an empty table gives an empty one.
    """
    return docs.mapInArrow(partial(_clean_rows, held=_Held(docs.sparkSession, model), threshold=threshold), docs.schema)


def learnable(column: str = "doc_id"):
    return crc_mod(column, 5) != 0
