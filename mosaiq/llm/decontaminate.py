"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Words are compared without case and outer punctuation. The CGK random walk reads a window of words:
each step puts out the word under the cursor and moves on by a bit that step and word fix, so windows
a few edits apart agree in most steps. A walk has two steps a word, in which fair bits bring the cursor
to the window's end; later steps would put out padding alone, on which all windows agree. Tables of
sampled steps look a document's windows up among the windows of the items; what they propose is verified
by exact edit distance of the whole item to the best-fitting run of the document's words.

Items are put into classes by length (each up to twice the least). Windows of a class are a fifth
shorter than its least item, so that each place of an item in a document holds whole windows: those
of items are indexed at every word, those of documents looked up at a stride that meets each place
twice. Tables are as many as the target recall asks for. Items of fewer than WINDOWED words allow no
edit; they are looked up whole, at every word.

An item is in a document if at most `tolerance` of its words must be edited. Null and empty texts hold
no items; null and empty items are in no text. Repeated rows of documents give repeated results; equal
rows of items count once, items of different ids or of a null id each. Ids may be of any type. The items
are the query set: they are taken in blocks of ITEMS rows, each broadcast on its own; all documents meet
every block. Without items or documents there are no results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Memo, mapped, mix, slices

#: Items of so many words have windows and may be edited.
WINDOWED = 5
ITEMS = 5000
_U = np.uint64
_PAD = _U(0)
_OUTER = "".join(c for c in map(chr, range(33, 0x250)) if not c.isalnum()) + "‐‑‒–—―‘’‚“”„…‹›·¿¡"


def word_hash(word: str) -> int:
    w = word.lower().strip(_OUTER)
    return xxhash.xxh64_intdigest((w or word).encode("utf-8", "surrogatepass"), 9) | 1


def edit_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The least edit distance of item to any run of words, and where the first such run ends."""
    j = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(item.tolist(), 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (words != w))
        row = np.minimum.accumulate(np.concatenate([[i], step]) - j) + j
    return int(row.min()), int(row.argmin())


def _whole(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    m = len(h) - n + 1
    out = np.full(max(m, 0), n, _U)
    for i in range(n if m > 0 else 0):
        out = mix(out + h[i : i + m])
    return out


class LengthClass:
    """Tables of the windows of items of like length."""

    def __init__(self, items: list[tuple[object, np.ndarray]], least: int, tables: int, sampled: int, seed: int):
        self.items = items
        self.size = max(3, least * 4 // 5)
        self.stride = max(1, (least - self.size + 1) // 2)
        self.steps = 2 * self.size
        rng = np.random.default_rng(seed)
        self.at = [np.sort(rng.choice(self.steps, min(sampled, self.steps), replace=False)) for _ in range(tables)]
        self.odd = [rng.integers(1, 2**63, len(a), dtype=_U) | _U(1) for a in self.at]
        keys, which, offset = [], [], []
        for k, (_, h) in enumerate(items):
            starts = np.arange(max(1, len(h) - self.size + 1))
            for key in self.keys(self.walk(np.concatenate([h, np.zeros(2 * self.steps, _U)]), starts)):
                keys.append(key)
                which.append(np.full(len(starts), k))
                offset.append(starts)
        key, which, offset = np.concatenate(keys), np.concatenate(which), np.concatenate(offset)
        order = np.argsort(key, kind="stable")
        self.key, self.which, self.offset = key[order], which[order], offset[order]
        self.lengths = np.array([len(h) for _, h in items], np.int64)
        self.has = np.zeros((len(items), 1024), bool)
        for k, (_, h) in enumerate(items):
            self.has[k, (h >> _U(20)).astype(np.int64) & 1023] = True
        self.some = np.zeros(1 << 22, bool)
        self.some[(self.key >> _U(42)).astype(np.int64)] = True

    def walk(self, h: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """The embedding of the window at each start: the words put out at each step."""
        at, end, out = starts.copy(), starts + self.size, []
        for j in range(self.steps):
            w = h[at]
            out.append(np.where(at < end, w, _PAD))
            at += ((w >> _U(1 + j % 63)) & _U(1)).astype(at.dtype)
        return out

    def keys(self, out: list[np.ndarray]) -> Iterator[np.ndarray]:
        for t, (at, odd) in enumerate(zip(self.at, self.odd, strict=True)):
            key = np.full(len(out[0]), t, _U)
            for j, m in zip(at.tolist(), odd, strict=True):
                key += out[j] * m
            yield mix(key)

    def proposals(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the places in h at which they would begin, where a window shares a table's key."""
        items, begins = [], []
        for key in self.keys(self.walk(h, starts)):
            hit = np.flatnonzero(self.some[(key >> _U(42)).astype(np.int64)])
            low, high = np.searchsorted(self.key, key[hit]), np.searchsorted(self.key, key[hit], side="right")
            n = high - low
            if n.any():
                at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                items.append(self.which[at])
                begins.append(np.repeat(starts[hit], n) - self.offset[at])
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(items), np.concatenate(begins)


    def plausible(self, h: np.ndarray, items: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float) -> np.ndarray:
        """Which proposals have, around the place, as many words of the item as must be left unedited
        (by ten bits of their hashes, so none is lost)."""
        slack = (tolerance * self.lengths[items]).astype(np.int64)
        out = np.zeros(len(items), bool)
        reach = np.arange(int(self.lengths.max()) + 4 * int(tolerance * int(self.lengths.max())) + 1)
        for a in range(0, len(items), 8192):
            k, s = items[a : a + 8192, None], slack[a : a + 8192, None]
            place = at[a : a + 8192, None] - 2 * s + reach
            inside = (reach < self.lengths[k] + 4 * s) & (place >= low[a : a + 8192, None]) & (place < high[a : a + 8192, None])
            word = (h[np.where(inside, place, 0)] >> _U(20)).astype(np.int64) & 1023
            out[a : a + 8192] = (self.has[k, word] & inside).sum(axis=1) >= (self.lengths[k] - s)[:, 0]
        return out


class Index:
    """Items by length class; `recall` for an item at the tolerance, if edits fall anywhere."""

    def __init__(self, items: list[tuple[object, str]], tolerance: float = 0.2, recall: float = 0.95, sampled: int = 4, seed: int = 5):
        agree = max(0.3, 1 - 1.6 * tolerance)
        tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled)) if tolerance else 1
        self.tolerance, self.classes = tolerance, []
        self.words = Memo(word_hash, 150_000)
        by: dict[int, list] = {}
        #: Of short items, by their number of words: hash -> ids.
        self.short: dict[int, dict[int, list]] = {}
        for i, text in items:
            h = np.array([word_hash(w) for w in (text or "").split()], _U)
            if len(h) >= WINDOWED:
                by.setdefault(len(h).bit_length(), []).append((i, h))
            elif len(h):
                self.short.setdefault(len(h), {}).setdefault(int(_whole(h, len(h))[0]), []).append(i)
        for bits, some in sorted(by.items()):
            self.classes.append(LengthClass(some, min(len(h) for _, h in some), tables, sampled, seed + bits))

    def _short(self, h: np.ndarray, begins: np.ndarray, lengths: np.ndarray, best: list[dict]) -> None:
        """Enters the first place of each short item in each text."""
        for n, names in self.short.items():
            keys = _whole(h, n)
            at = np.flatnonzero(np.isin(keys, np.array(list(names), _U)))
            of = np.searchsorted(begins, at, side="right") - 1
            for p, d in zip(at.tolist(), of.tolist(), strict=True):
                first = p - int(begins[d])
                if first + n <= lengths[d]:
                    for i, name in enumerate(names[int(keys[p])]):
                        best[d].setdefault((n, int(keys[p]), i), (name, 0, first, first + n))

    def find(self, texts: list[str | None], least: int = 1) -> list[list[tuple[object, int, int, int]]]:
        """For each text (item id, edit distance, first word, end word) of the items of `least` words or
        more in it, best place each."""
        split = [(t or "").split() for t in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        gap = max((c.steps for c in self.classes), default=0) + 1
        begins = np.cumsum(lengths + gap) - lengths - gap
        h = np.zeros(int((lengths + gap).sum()), _U)
        for w, b in zip(split, begins, strict=True):
            h[b : b + len(w)] = np.fromiter(map(self.words.__getitem__, w), _U, len(w))
        self.words.trim()
        best: list[dict[object, tuple[object, int, int, int]]] = [{} for _ in texts]
        if least < WINDOWED:
            self._short(h, begins, lengths, best)
        for c in self.classes:
            starts = np.concatenate([np.arange(b, b + n, c.stride) for b, n in zip(begins, lengths, strict=True)]) if len(texts) else begins
            if not len(starts):
                continue
            items, at = c.proposals(h, starts)
            pairs = np.unique(items * len(h) + at + c.size)
            items, at = pairs // len(h), pairs % len(h) - c.size
            of = np.searchsorted(begins, at + c.size, side="right") - 1
            good = c.plausible(h, items, at, begins[of], begins[of] + lengths[of], self.tolerance)
            for k, begin, d in zip(items[good].tolist(), at[good].tolist(), of[good].tolist(), strict=True):
                name, item = c.items[k]
                if len(item) < least:
                    continue
                slack = int(self.tolerance * len(item))
                held = best[d].get((id(c), k))
                if held and (held[1] == 0 or held[2] - slack <= begin - begins[d] <= held[2] + slack):
                    continue
                a, b = max(int(begins[d]), begin - 2 * slack), min(int(begins[d] + lengths[d]), begin + len(item) + 2 * slack)
                words = h[a:b]
                if sum((Counter(item.tolist()) & Counter(words.tolist())).values()) < len(item) - slack:
                    continue
                distance, end = edit_match(item, words)
                if distance <= slack and (held is None or distance < held[1]):
                    last = a - int(begins[d]) + end
                    back, length = edit_match(item[::-1], words[:end][::-1])
                    best[d][id(c), k] = (name, distance, last - (length if back == distance else len(item)), last)
        return [sorted(x.values(), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1:])) for x in best]


def _blocks(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, tolerance: float, recall: float) -> Iterator:
    """Broadcast indexes of the items, ITEMS of them in each on average; one index, if empty, at least."""
    asked = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    blocks = max(1, math.ceil(asked.count() / ITEMS))
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        yield docs.sparkSession.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in rows], tolerance, recall))


def contaminated(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", tolerance: float = 0.2, recall: float = 0.95) -> DataFrame:
    """A row for each document and item in it: the columns in `keep`, item_id, distance (edits in
    words), first_word and end_word in the document."""
    keep = [c for c in keep if c not in ("item_id", "distance", "first_word", "end_word")]
    names = ["item_id", "distance", "first_word", "end_word"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("item_id", items.schema[item_id].dataType)] + [T.StructField(n, T.LongType()) for n in names[1:]])
    kinds = [to_arrow_type(items.schema[item_id].dataType), pa.int64(), pa.int64(), pa.int64()]
    narrow = docs.select(*keep, docs[text].alias("__text"))

    def scan(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for part, texts in slices(batch, "__text"):
                    found = index.find(texts)
                    rows = pa.array(np.repeat(np.arange(len(texts)), [len(x) for x in found]))
                    flat = [x for some in found for x in some]
                    yield pa.RecordBatch.from_arrays([part.column(i).take(rows) for i in range(len(keep))] + [pa.array([x[i] for x in flat], kinds[i]) for i in range(4)], names=[*keep, *names])

        return mapped(narrow, run, schema)

    out = None
    for sent in _blocks(docs, items, item_id, item_text, tolerance, recall):
        out = scan(sent) if out is None else out.union(scan(sent))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", tolerance: float = 0.2, recall: float = 0.95, least: int = WINDOWED) -> DataFrame:
    """The rows of docs that hold no item of `least` words or more, as they are. A shorter item, as an
    answer of one word, is in texts that have nothing to do with it: it is found by contaminated()."""
    for sent in _blocks(docs, items, item_id, item_text, tolerance, recall):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, text):
                    yield part.filter(pa.array([not x for x in sent.value.find(texts, least)], pa.bool_()))

        docs = mapped(docs, run, docs.schema)
    return docs
