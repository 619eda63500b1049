"""Line deduplication by winnowing.

A gram is GRAM words in a row, wherever lines end. Of every WINDOW neighbouring grams the one of least
hash is a fingerprint, so any two runs of GRAM + WINDOW - 1 (51) equal words share one for certain, and
of a longer shared run the fingerprints are at most WINDOW words apart, so that their grams leave no gap.
Fingerprints are joined by hash to the first document that has them, and each match is extended word by
word both ways, by WINDOW - 1 words, beyond which the next fingerprint matches on its own. Runs of
matched words of MIN_WORDS or more (each gram has as many) are deleted where they come later: in
documents of a larger doc_id, or later in the same one.

All that stands before is kept, so what is deleted is left in an earlier place. Word hashes used in
extending have 32 bits, fingerprints 64. Only the first document of a fingerprint is compared: if it has
a part of a run that another earlier document has whole, up to WINDOW - 1 words may stay at either end.

Null texts stay null, empty ones empty; an empty table gives no rows. doc_id is taken as a long. Rows of
one doc_id count as one document: they aren't compared with each other. Rows of a null doc_id come after
all others: they are compared with those that have one, and not with each other. Names of columns that
begin with two underscores are for this module.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_CHARS, Memo, mapped, mix, slices, written

GRAM, WINDOW, MIN_WORDS = 30, 22, 30
_SIDE = WINDOW - 1
#: Rows of a null id have keys from here on, one for each text.
_NULLS = 2**62
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_word = re.compile(r"\S+")
_steps = np.arange(_SIDE)


class Words:
    """Words and fingerprints of some texts. hash (32 bits) runs over all words of all texts, `at` has
    each text's first word and the end; picked are the places of the fingerprints' first words, fp the
    hashes of their grams (64 bits), and `cut` each text's first fingerprint and the end."""

    def __init__(self, texts: list[str | None], memo: Memo):
        own, counts = [], []
        for t in texts:
            w = t.split() if t else []
            own += w
            counts.append(len(w))
        h = np.fromiter(map(memo.__getitem__, own), _U, len(own))
        memo.trim()
        n = len(h)
        self.at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.hash = (h >> _U(32)).astype(np.uint32).view(np.int32)
        self.picked, self.fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = n - GRAM + 1
        if m > 0:
            power = np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, _BASE, _U))])
            back = np.concatenate([[_U(1)], np.cumprod(np.full(m - 1, _BACK, _U))])
            total = np.concatenate([[_U(0)], np.cumsum(h * power)])
            gram = mix((total[GRAM:] - total[:-GRAM]) * back)
            i = np.arange(m)
            left = np.repeat(self.at[1:], counts)[:m] - i
            # the place in the low bits: of equal grams in a window the last is picked
            mask = _U((1 << max(24, n.bit_length())) - 1)
            low = np.where(left >= GRAM, gram & ~mask | (mask - i.astype(_U)), _U(2**64 - 1))
            span = 1
            while span < min(WINDOW, m):
                step = min(span, WINDOW - span)
                low, span = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0], span + step
            picked = np.zeros(m, bool)
            picked[(mask - (low[left[: len(low)] >= GRAM + _SIDE] & mask)).astype(np.int64)] = True
            # texts with fewer grams than a window: all of them
            picked |= (left >= GRAM) & (np.repeat(counts, counts)[:m] < GRAM + _SIDE)
            self.picked = np.flatnonzero(picked)
            self.fp = gram[self.picked].view(np.int64)
        self.cut = np.searchsorted(self.picked, self.at)

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, places of fingerprints and fingerprints of text k."""
        a, s = self.at[k], slice(self.cut[k], self.cut[k + 1])
        return self.hash[a : self.at[k + 1]], self.picked[s] - a, self.fp[s]


def around(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each gram the words before it, the nearest first, and those after it; zeros beyond the text."""
    padded = np.concatenate([np.zeros(_SIDE, np.int32), words, np.zeros(_SIDE, np.int32)])
    return padded[np.hstack([at[:, None] + (_SIDE - 1) - _steps, at[:, None] + _SIDE + GRAM + _steps])]


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(_NULLS - 1) + F.lit(_NULLS))


def _memo() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 3))


def _fingerprints(docs: DataFrame) -> DataFrame:
    """o (the row's key), fp, and repeats: whether a fingerprint comes twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                x = Words(texts, memo)
                every = [x.of(k)[2] for k in range(len(texts))]
                once = [np.unique(f) for f in every]
                repeats = [len(a) < len(b) for a, b in zip(once, every, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(once, pa.list_(pa.int64())), pa.array(repeats)], names=["o", "fp", "repeats"])

    return mapped(docs.select(_key().alias("o"), "text"), run, "o long, fp array<long>, repeats boolean")


def _runs_of_rows(col: pa.Array, rows: np.ndarray) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and texts of some rows of a column, about SLICE_CHARS bytes at a time."""
    sizes = np.cumsum(np.asarray(pc.binary_length(col.take(pa.array(rows, pa.int64())))))
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE_CHARS)))
        yield rows[at:end].tolist(), col.take(pa.array(rows[at:end], pa.int64())).to_pylist()
        at = end


def _contexts(place: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For wanted fingerprints of first documents, the words around their gram. The text is column
    `place`; the last two columns are the wanted hashes and the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in batches:
            col, wanted, doc = batch.column(place), *batch.columns[-2:]
            for rows, texts in _runs_of_rows(col, np.flatnonzero(np.asarray(col.is_valid()))):
                x = Words(texts, memo)
                hashes, near, docs = [], [], []
                for k, i in enumerate(rows):
                    words, at, fp = x.of(k)
                    once, first = np.unique(fp, return_index=True)
                    some = np.isin(once, np.asarray(wanted[i].values))
                    hashes.append(once[some])
                    near.append(around(words, at[first[some]]).ravel())
                    docs.append(np.full(int(some.sum()), doc[i].as_py(), np.int64))
                h, v = np.concatenate(hashes), np.concatenate(near)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * 2 * _SIDE, pa.int32()), pa.array(v, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), lists, pa.array(np.concatenate(docs), pa.int64())], names=["h", "near", "m"])

    return run


def _seeds(column: pa.ListArray):
    """A function of a row number: fingerprints and the words around them in their first documents."""
    rows, held = np.asarray(column.offsets), column.values
    valid = np.asarray(held.is_valid())
    h = held.field("h").filter(pa.array(valid)).to_numpy(zero_copy_only=False)
    near = held.field("near").filter(pa.array(valid)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * _SIDE)
    place = np.concatenate([[0], np.cumsum(valid)])
    return lambda i: (h[place[rows[i]] : place[rows[i + 1]]], near[place[rows[i]] : place[rows[i + 1]]])


def repeated(x: Words, k: int, seeds: tuple[np.ndarray, np.ndarray], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Runs of words (begin, end) of text k that were matched or come a second time in it."""
    words, at, fp = x.of(k)
    if not len(at):
        return []
    order = np.argsort(fp, kind="stable")
    low, high = (np.searchsorted(fp[order], seeds[0], side) for side in ("left", "right"))
    n = high - low
    seed = np.repeat(np.arange(len(n)), n)
    here = at[order[np.arange(len(seed)) - np.repeat(np.cumsum(n) - n, n) + low[seed]]]
    there = seeds[1][seed]
    _, first, which = np.unique(fp, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[which] < np.arange(len(fp)))
    if len(again):
        here = np.concatenate([here, at[again]])
        there = np.concatenate([there, around(words, at[first[which[again]]])])
    odd = around(words, here) != there
    reach = [np.where(side.any(axis=1), side.argmax(axis=1), _SIDE) for side in (odd[:, :_SIDE], odd[:, _SIDE:])]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, here - np.minimum(reach[0], here), 1)
    np.add.at(cover, here + GRAM + np.minimum(reach[1], len(words) - here - GRAM), -1)
    on = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2) if b - a >= least]


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the words of the runs and the white space after them."""
    at = [m.start() for m in _word.finditer(text)] + [len(text)]
    out, kept = [], 0
    for a, b in runs:
        out.append(text[kept : at[a]])
        kept = at[b]
    return "".join([*out, text[kept:]]).strip() if runs else text


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs with text less its later repeated runs, and n_removed, the number of words deleted. Every
    row stays. docs has doc_id and text; other columns are kept as they are."""
    found = written(_fingerprints(docs))
    # repeated rows of a null id are one row here
    table = found.where(F.col("o") < _NULLS).union(found.where(F.col("o") >= _NULLS).dropDuplicates(["o"]))
    each = table.select("o", F.explode("fp").alias("h"))
    # no filter on m itself: one would reach the texts of one join alone, which then were shuffled twice
    firsts = each.groupBy("h").agg(F.min(F.when(F.col("o") < _NULLS, F.col("o"))).alias("m"), F.max("o").alias("x")).where("x > m")
    wanted = firsts.groupBy("m").agg(F.collect_list("h").alias("want"))
    names = [c for c in docs.columns if c != "n_removed"]
    place = names.index("text")
    # one exchange of the texts serves both joins, as both take all of its columns
    keyed = docs.select(*names, _key().alias("__o"))
    sources = keyed.join(wanted, F.col("__o") == F.col("m")).select(*names, "want", "__o")
    contexts = mapped(sources, _contexts(place), "h long, near array<int>, m long")
    # a join of two exchanges alone, so that a fingerprint of very many documents can be split
    seeds = each.join(contexts, "h").where("o > m").select("o", F.struct("h", "near").alias("s"))
    found = seeds.union(table.where("repeats").select("o", F.lit(None).cast(seeds.schema["s"].dataType).alias("s"))).groupBy("o").agg(F.collect_list("s").alias("__seeds"))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n_removed", T.LongType())])
    joined = keyed.join(found.withColumnRenamed("o", "__o"), "__o", "left").select(*names, "__seeds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in batches:
            col, seeds = batch.column(place), batch.column(len(names))
            some = np.flatnonzero(np.asarray(seeds.is_valid()) & np.asarray(col.is_valid()))
            found, removed = _seeds(seeds), np.zeros(batch.num_rows, np.int64)
            changed, new = np.zeros(batch.num_rows, bool), []
            for rows, texts in _runs_of_rows(col, some):
                x = Words(texts, memo)
                for k, i in enumerate(rows):
                    if runs := repeated(x, k, found(i), least):
                        new.append(without(texts[k], runs))
                        changed[i] = True
                        removed[i] = sum(b - a for a, b in runs)
            text = pc.replace_with_mask(col, pa.array(changed), pa.array(new, pa.string())) if new else col
            yield pa.RecordBatch.from_arrays([*(batch.column(j) if j != place else text for j in range(len(names))), pa.array(removed)], names=schema.names)

    return mapped(joined, run, schema)
