"""Bottom-k sketches of word shingles: a document's k smallest distinct shingle hashes.

Sketches of parts merge into the sketch of the whole. Two of them estimate resemblance (shared
share of the k smallest of both), containment and the number of distinct shingles.

Words are runs of non-white space in lower case, shingles five words (a shorter text: all its words
as one). Null text: as an empty one, with an empty sketch. Two empty sketches have likeness 1, an
empty and another 0. Equal texts have equal sketches, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, shingles

K = 128
_U = np.uint64


class Sketcher:
    """Sketches of texts; word hashes are kept between texts."""

    def __init__(self, k: int = K, n: int = 5):
        self.k, self.n = k, n
        self.words = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        h = shingles(np.fromiter(map(self.words.__getitem__, words), _U, len(words)), self.n)
        self.words.trim()
        if len(h) > 8 * self.k:
            few = np.unique(np.partition(h, 2 * self.k)[: 2 * self.k])
            if len(few) >= self.k:
                return few[: self.k]
        return np.unique(h)[: self.k]


def pack(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def unpack(sketch: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(sketch), ">u8").astype(_U)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the union of two shingle sets that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = np.append(both[1:] == both[:-1], False)
    first = np.append(True, both[1:] != both[:-1])
    some = twice[first][:k]
    return float(some.sum() / len(some))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact while there are fewer than k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * distinct(merge(a, b, k), k) / distinct(a, k))


def bottom_k(docs: DataFrame, keep: list[str], text: str = "text", k: int = K, n: int = 5) -> DataFrame:
    """The columns in `keep`, `sketch` (base64 of big-endian hashes) and `n_shingles`, the estimate."""
    keep = [c for c in keep if c not in ("sketch", "n_shingles")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("sketch", T.StringType()), T.StructField("n_shingles", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sketcher(k, n)
        for batch in batches:
            got = [make(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([pack(x) for x in got], pa.string()), pa.array([distinct(x, k) for x in got], pa.float64())], names=[*keep, "sketch", "n_shingles"])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def merged(sketches: DataFrame, by: str, k: int = K) -> DataFrame:
    """One sketch for each value of `by`. Each task merges what it has first, so a group's last
    merge gets a row for each task at most."""
    schema = T.StructType([sketches.schema[by], T.StructField("sketch", T.StringType())])

    def part(frames):
        held: dict = {}
        for f in frames:
            for key, s in zip(f[by], f["sketch"], strict=True):
                key = None if key != key else key
                held[key] = merge(held[key], unpack(s), k) if key in held else unpack(s)
        import pandas as pd

        yield pd.DataFrame({by: list(held), "sketch": [pack(x) for x in held.values()]})

    def whole(frame):
        out = unpack(frame["sketch"].iloc[0])
        for s in frame["sketch"].iloc[1:]:
            out = merge(out, unpack(s), k)
        return frame.iloc[:1].assign(sketch=pack(out))[[by, "sketch"]]

    return sketches.select(by, "sketch").mapInPandas(part, schema).groupBy(by).applyInPandas(whole, schema)


def _tree(col: Column, bounds: list[int], low: int = 0, high: int | None = None) -> Column:
    """How many of the descending bounds are larger than col, as a balanced tree of comparisons."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(col < F.lit(bounds[mid]), _tree(col, bounds, mid + 1, high)).otherwise(_tree(col, bounds, low, mid))


def _range(col: Column, bounds: list[int]) -> Column:
    """The same for any number of bounds: a tree finds the run of them, comparisons the place in it."""
    step = max(1, math.isqrt(len(bounds)))
    if len(bounds) <= 64:
        return _tree(col, bounds)
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    run = _tree(col, [r[0] for r in runs[1:]])
    inner = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in runs]), run + 1)
    return (run * step + F.size(F.filter(inner, lambda b: b > col))).cast("int")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text and columns that deal each row with the row after it to one partition: bucket
    (a range of doc_id), context (true for the copy of a later bucket's first row) and tie. Order is
    descending doc_id, nulls last, then descending tie; after the last row comes the first.

    Only quantiles of doc_id and the first row's id of each bucket reach the driver: `buckets` rows."""
    spark = docs.sparkSession
    buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    found = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("b")).first()["b"]
    bounds = sorted(set(found or []), reverse=True)
    dealt = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(_range(F.col("doc_id"), bounds)))
    heads = sorted((r["bucket"], r["h"]["doc_id"], r["h"]["tie"]) for r in dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("h")).collect())
    before = {h[0]: heads[i - 1][0] for i, h in enumerate(heads)}
    if heads:
        # a row for each range
        known = spark.createDataFrame([(b, i, t, before[b]) for b, i, t in heads], "bucket int, head long, head_tie long, before int")
        dealt = dealt.join(F.broadcast(known), "bucket")
        first = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie"))
        copies = F.when(first, F.array(F.struct(F.col("bucket"), F.lit(False).alias("context")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("context"))))
        dealt = dealt.withColumn("to", F.explode(copies.otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("context"))))))
        dealt = dealt.select("doc_id", "text", "tie", "to.bucket", "to.context")
    else:
        dealt = dealt.withColumn("context", F.lit(False))
    # each range is a partition of its own
    return dealt.repartitionById(len(bounds) + 2, "bucket").sortWithinPartitions("bucket", "context", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())


def edited_likeness(docs: DataFrame, k: int = K, n: int = 5) -> DataFrame:
    """For each document its sketch and that of its edited text (the last floor(n_chars/2) code points
    replaced by as many of the next document's first, or all), with estimated resemblances."""
    fields = [("doc_id", T.LongType(), pa.int64()), ("n_chars", T.LongType(), pa.int64()), ("edited_sha256", T.StringType(), pa.string()), ("fingerprint", T.StringType(), pa.string()), ("edited_fingerprint", T.StringType(), pa.string()), ("near_edited", T.DoubleType(), pa.float64()), ("near_next", T.DoubleType(), pa.float64())]
    schema = T.StructType([T.StructField(a, b) for a, b, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, out, last, done = Sketcher(k, n), [], None, None

        def pair(row, follower):
            doc_id, text, own = row
            half = len(text) // 2
            edited = text[: len(text) - half] + follower[1][:half]
            e = make(edited)
            out.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(own), pack(e), resemblance(own, e, k), resemblance(own, follower[2], k)))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[f[0] for f in fields])
            out.clear()
            return batch

        for batch in batches:
            for doc_id, text, bucket, context in zip(*(batch.column(i) for i in range(4)), strict=True):
                bucket, context = bucket.as_py(), context.as_py()
                if context and done == bucket:  # a further copy of the first row after this bucket
                    continue
                text = text.as_py()
                row = (doc_id.as_py(), text, make(text))
                if last is not None:
                    pair(last, row)
                last, done = (None, bucket) if context else (row, None)
                if len(out) >= 2000:
                    yield flush()
        if out:
            yield flush()

    return with_next(docs).select("doc_id", "text", "bucket", "context").mapInArrow(run, schema)
