"""Near-duplicates by the Jaccard similarity of five-word shingles, over all texts.

The 32-bit hashes of a text's shingles are its set; equal sets count once. MinHash bands put sets of
similarity LEAST or more into a common bucket (BANDS of ROWS: at 0.8 but for one pair in 2,800). A
bucket's sets are compared with representatives, picked by one of ORDERS hash orders by the band, never
with each other, so a group of thousands is a few comparisons each. Sets are compared exactly.

Texts of fewer words than a shingle are one shingle; null and empty ones link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, mapped, mix, shingles, slices, written

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS, ORDERS = 20, 5, 4
_U = np.uint64
_salts = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_powers = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(ROWS)], _U)


def shingle_set(text: str | None, memo: Memo, n: int = SHINGLE) -> np.ndarray:
    words = (text or "").lower().split()
    return np.unique((shingles(np.fromiter(map(memo.__getitem__, words), _U, len(words)), n) >> _U(32)).astype(np.uint32))


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band, from the least of ROWS hashes each."""
    base = mix(s.astype(_U) + _U(0x632BE59BD9B4E019))
    least = np.min([(base[at : at + 4096, None] * _salts).min(axis=0) for at in range(0, len(base), 4096)], axis=0)
    return mix((mix(least).reshape(BANDS, ROWS) * _powers).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def sets(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, s (the hash of a set), bands and items, of texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 5), 150_000)
        for batch in batches:
            for part, texts in slices(batch, "__text"):
                found = [shingle_set(t, memo) for t in texts]
                memo.trim()
                some = [i for i, f in enumerate(found) if len(f)]
                keys = [xxhash.xxh64_intdigest(found[i].tobytes(), 7) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(some, pa.int64())), pa.array(np.array(keys, _U).view(np.int64)), pa.array([bands(found[i]) for i in some], pa.list_(pa.int64())), pa.array([found[i].tobytes() for i in some], pa.binary())],
                    names=["__by", "s", "bands", "items"],
                )

    kind = docs.schema[by].dataType.simpleString()
    return mapped(docs.select(F.col(by).alias("__by"), F.col(text).alias("__text")), run, f"__by {kind}, s long, bands array<long>, items binary")


def links(table: DataFrame, least: float = LEAST) -> DataFrame:
    """table: what sets() gives. Links a-b between sets of similarity `least` or more."""
    each = table.select("s", F.posexplode("bands").alias("i", "key")).select("s", "key", F.xxhash64("s", F.col("i") % ORDERS).alias("o")).distinct()
    # written, so that a bucket of very many sets can be split in the join of two exchanges alone
    heads = each.groupBy("key").agg(F.min(F.struct("o", "s")).alias("head"), F.min("s").alias("x"), F.max("s").alias("y")).where("x < y")
    heads = written(heads.select("key", F.col("head.s").alias("b")))
    pairs = written(each.join(heads, "key").where("s <> b").select(F.least("s", "b").alias("a"), F.greatest("s", "b").alias("b")).distinct())
    once = table.join(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "s", "left_semi").select("s", "items").dropDuplicates(["s"])
    held = written(once)
    both = pairs.join(held.select(F.col("s").alias("a"), F.col("items").alias("p")), "a").join(held.select(F.col("s").alias("b"), F.col("items").alias("q")), "b").select("a", "b", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [jaccard(np.frombuffer(p.as_py(), np.uint32), np.frombuffer(q.as_py(), np.uint32)) >= least for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return mapped(both, run, "a long, b long")
