"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct words, the beginnings of words that one, two or four different words
of the text have, and the size of the text in powers of two, all hashed. The score is the logistic of a
bias, a weight for each term and the scalar products of the factors of each pair of terms, so a pair (an
insult with a mention of a group, a beginning that is frequent in a text of that size) can count where
neither term does alone. Terms that tell the classes apart best by themselves are kept, each with factors.

Null and empty texts have no features: their score is the logistic of the bias, which is near the learned
share of the class but not equal to it, as the rarer class weighs more. Equal texts
have equal scores. Rows without label aren't learned from; where no rows or one class are left, the
model knows the bias alone. Of repeated ids the largest label counts, and the text of the smallest hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Labelled documents that a model learns from at most, those of the smallest hashed ids.
FIT_DOCUMENTS = 6000
#: Terms of a model at most, unless `fit` is told another number: those that tell the classes apart best by themselves.
TERMS = 4096
_FACTORS = 8
_words = re.compile(r"[^\W\d_]+")


def _term(word: str, kind: str = "") -> int:
    return zlib.crc32(f"{kind}{word}".encode("utf-8", "surrogatepass"))


def terms(word: str) -> list[int]:
    """A word's hashed features: the word; for its first four and its first five letters, that one, two
    and four different words of the text begin so (a word of under five letters has none of these)."""
    return [_term(word), *(_term(word[:n], f"{n}.{times} ") if len(word) >= 5 else -1 for n in (4, 5) for times in TIMES)]


#: How many different words of a text have a beginning, for a feature of its own.
TIMES = (1, 2, 4)


class Features:
    """Sorted distinct features of texts; those of words are kept between texts. With a vocabulary
    (sorted hashes), features are places in it, and others are left out."""

    def __init__(self, vocabulary: np.ndarray | None = None, limit: int = 250_000):
        self.vocabulary, self.limit = vocabulary, limit
        self.at: dict[str, int] = {}
        self.begins: dict[str, int] = {}
        self.table = np.zeros((0, 9), np.int64)
        self.sizes = self._place(np.array([_term(str(i), "size ") for i in range(64)], np.int64))

    def _place(self, h: np.ndarray) -> np.ndarray:
        if self.vocabulary is None:
            return h
        at = np.searchsorted(self.vocabulary, h)
        return np.where(np.append(self.vocabulary, -2)[at] == h, at, -1)

    def _of(self, words: list[str]) -> np.ndarray:
        """Features of words, then numbers of their beginnings of four and five letters, by which they
        are counted; words of under five letters have the number 0."""
        numbers = [[self.begins.setdefault(w[:n], len(self.begins) + 1) if len(w) >= 5 else 0 for n in (4, 5)] for w in words]
        return np.hstack([self._place(np.array([terms(w) for w in words], np.int64)), np.array(numbers, np.int64)])

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.at) > self.limit:
            self.at, self.begins, self.table = {}, {}, self.table[:0]
        split = [_words.findall((t or "").lower()) for t in texts]
        found = [set(w) for w in split]
        if new := list(set().union(*found).difference(self.at)):
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self._of(new)])
        out = []
        for every, w in zip(split, found, strict=True):
            rows = self.table[np.fromiter(map(self.at.__getitem__, w), np.int64, len(w))]
            own = [rows[:, 0]]
            for k in (0, 1):
                _, first, n = np.unique(rows[:, 7 + k], return_index=True, return_counts=True)
                own += [rows[first[n >= times], 1 + 3 * k + j] for j, times in enumerate(TIMES)]
            if every:
                own.append(self.sizes[[len(every).bit_length()]])
            x = np.unique(np.concatenate(own))
            out.append(x[1:] if len(x) and x[0] < 0 else x)
        return out


@dataclass
class FactorizationMachine:
    """bias; vocabulary: sorted hashes of terms; their weights; paired: their row of factors, or -1."""

    bias: float
    vocabulary: np.ndarray
    weights: np.ndarray
    paired: np.ndarray
    factors: np.ndarray

    def score(self, docs: list[np.ndarray]) -> list[float]:
        """docs: places in the vocabulary."""
        out = []
        for ids in docs:
            z = self.bias + float(self.weights[ids].sum())
            rows = self.paired[ids]
            if len(v := self.factors[rows[rows >= 0]]) > 1:
                z += 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
            out.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
        return out


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.5, decay: float = 1e-3, seed: int = 7, most: int = TERMS) -> FactorizationMachine:
    """Adagrad on the logistic loss, over terms of three documents or more. The rarer class counts for
    up to three times as much, as a missed toxic text costs more than a doubtful one."""
    y = labels.astype(float)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    none = np.zeros(0, np.int64)
    if len(y) == 0 or y.min() == y.max() or not sum(map(len, docs)):
        return FactorizationMachine(float(np.log(share / (1 - share))), none, np.zeros(0), none, np.zeros((0, _FACTORS)))
    vocabulary, df = np.unique(np.concatenate(docs), return_counts=True)
    vocabulary = vocabulary[df >= 3]
    df = df[df >= 3]
    place = [np.searchsorted(vocabulary, d) for d in docs]
    kept = [p[np.append(vocabulary, -1)[p] == d] for p, d in zip(place, docs, strict=True)]
    hit = np.bincount(np.concatenate(kept), np.repeat(y, [len(k) for k in kept]), len(vocabulary))
    gain = np.abs(hit - df * share) / np.sqrt(df * share * (1 - share) + 1.0)
    best = np.sort(np.argsort(-gain, kind="stable")[:most])
    vocabulary, moved = vocabulary[best], np.full(len(gain) + 1, -1)
    moved[best] = np.arange(len(best))
    kept = [m[m >= 0] for m in (moved[k] for k in kept)]
    size = len(vocabulary)
    paired = np.arange(size)
    weight = np.where(y == 1, min(3.0, (1 - share) / share), 1.0)
    rng = np.random.default_rng(seed)
    w, b, v = np.zeros(size), float(np.log(share / (1 - share))), rng.normal(0, 0.01, (size, _FACTORS))
    gw, gv, gb = np.full(size, 1e-2), np.full(v.shape, 1e-2), 1e-2
    rows = [p[p >= 0] for p in (paired[k] for k in kept)]
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            n = len(some)
            ids, of = np.concatenate([kept[i] for i in some]), np.repeat(np.arange(n), [len(kept[i]) for i in some])
            pr, po = np.concatenate([rows[i] for i in some]), np.repeat(np.arange(n), [len(rows[i]) for i in some])
            mine = v[pr]
            total = np.stack([np.bincount(po, mine[:, f], n) for f in range(_FACTORS)], axis=1)
            square = np.bincount(po, (mine**2).sum(axis=1), n)
            z = b + np.bincount(of, w[ids], n) + 0.5 * ((total**2).sum(axis=1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * weight[some] / n
            used, back = np.unique(ids, return_inverse=True)
            grad = np.bincount(back, g[of], len(used)) + decay * w[used]
            gw[used] += grad**2
            w[used] -= rate * grad / np.sqrt(gw[used])
            used, back = np.unique(pr, return_inverse=True)
            each = g[po][:, None] * (total[po] - mine)
            grad = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(_FACTORS)], axis=1) + decay * v[used]
            gv[used] += grad**2
            v[used] -= 0.1 * rate * grad / np.sqrt(gv[used])
            gb += g.sum() ** 2
            b -= rate * g.sum() / np.sqrt(gb)
    return FactorizationMachine(float(b), vocabulary, w, paired, v)


def fit(docs: DataFrame, labels: DataFrame, where: Column, text: str = "text", label: str = "toxic", by: str = "doc_id", limit: int = FIT_DOCUMENTS, most: int = TERMS) -> FactorizationMachine:
    """Learns `most` terms at most from at most `limit` labelled documents for which `where` holds, those whose hashed `by`
    is smallest. The sample of labels is bounded by `limit`, so it is broadcast to the join."""
    rows = labels.where(F.col(label).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.max(label).alias("label"))
    sample = rows.withColumn("h", F.xxhash64(by)).where(where).orderBy("h", by).limit(limit)
    found = docs.select(by, F.col(text).alias("text")).join(F.broadcast(sample), by).where(F.col("text").isNotNull()).groupBy(by).agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label")).orderBy(F.xxhash64(by), by).select("text", "label").collect()
    make = Features()
    kept: list[np.ndarray] = []
    for i in range(0, len(found), 500):
        kept += make([r["text"] for r in found[i : i + 500]])
    return train(kept, np.array([int(r["label"]) == 1 for r in found], bool), most=most)


def score(docs: DataFrame, model: FactorizationMachine, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in `keep` (one named score is left out) and score."""
    keep = [c for c in keep if c != "score"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by that of the sample it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        make = Features(machine.vocabulary)
        for batch in batches:
            for part, texts in slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(machine.score(make(texts)), pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
