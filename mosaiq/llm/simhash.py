"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in three bits at most differ in one at most in one half.
For each half of 32 bits the anchors are the codewords of the perfect Hamming code of length 31, with
the last bit as it is: every half is within the covering radius 1 of an anchor. A fingerprint has its
nearest anchor as its home and is replicated to all anchors within radius plus threshold (1 + 1) of
its half, 17 at most. Of two similar fingerprints, each then has a replica at the other's home, where
all 64 bits are compared. Equal fingerprints are compared once.

Where many distinct fingerprints share a home (near copies in thousands), homes and replicas are dealt
to a grid of bounded blocks; each block returns a spanning forest of its links, not its pairs.

Null and empty texts have fingerprint zero, which links like any other. Rows of one doc_id stay
separate rows. A null doc_id gets the component of its fingerprint, named by the smallest id in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, written
from .components import components, roots

#: Fingerprints with one home that plain pairs are made of; beyond it blocks are used.
DENSE = 48
#: Fingerprints on each side of a block.
BLOCK = 2048
_x = xxhash.xxh64_intdigest


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the XXH64 of the text's n-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(n, len(words))
    begins = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    h = np.array([_x(joined[a:b], seed) for a, b in zip(begins, (ends[k - 1 :] - 1).tolist(), strict=True)], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 16384):
        total += np.unpackbits(h[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", n: int = 3) -> DataFrame:
    """The columns in `keep` and fp, the fingerprint as a signed long."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), n) for t in batch.column(len(keep))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fp.view(np.int64))], names=schema.names)

    return mapped(docs.select(*keep, docs[text].alias("__text")), run, schema)


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Of the Hamming code on bits 0 to 30: the exclusive or of the numbers (from 1) of the set bits."""
    s = np.zeros(len(half), np.uint32)
    for j in range(5):
        mask = np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1))
        s |= (np.bitwise_count(half & mask) & 1).astype(np.uint32) << np.uint32(j)
    return s


#: For each syndrome the bits to turn for each codeword at distance 2: pairs of bits whose numbers give the syndrome.
_PAIRS = np.array([[0] * 15] + [[(1 << (p - 1)) | (1 << ((p ^ s) - 1)) for p in range(1, 32) if p < p ^ s and p ^ s < 32] for s in range(1, 32)], np.uint32)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the anchors within distance 2 of each half of the fingerprints (uint64), which
    fingerprint each belongs to, and whether it is the nearest."""
    keys, owners, homes = [], [], []
    every = np.arange(len(fp))
    for side in (0, 1):
        half = (fp >> np.uint64(32 * side)).astype(np.uint32)
        s = _syndrome(half)
        home = half ^ np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
        odd = np.flatnonzero(s)
        far = (half[odd, None] ^ _PAIRS[s[odd]]).ravel()
        for key, owner, is_home in ((home, every, True), (home ^ np.uint32(1 << 31), every, False), (far, np.repeat(odd, 15), False)):
            keys.append(key.astype(np.int64) | np.int64(side << 32))
            owners.append(owner)
            homes.append(np.full(len(key), is_home))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(homes)


def _replicated(distinct: DataFrame, homes_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 10_000):
                part = fp[at : at + 10_000]
                key, of, home = anchors(part.view(np.uint64))
                if homes_only:
                    key, of = key[home], of[home]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[of])], names=["key", "fp"])

    return mapped(distinct.select("fp"), run, "key long, fp long")


def forest(home: np.ndarray, replica: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sets of fingerprints that differ in `bits` at most, as a spanning forest."""
    a, b = [], []
    for at in range(0, len(home), 256):
        part = home[at : at + 256]
        i, j = np.nonzero(np.bitwise_count(part.view(np.uint64)[:, None] ^ replica.view(np.uint64)[None, :]) <= bits)
        if len(i):
            n, r = roots(part[i], replica[j])
            a.append(n[n != r])
            b.append(r[n != r])
    if not a:
        return home[:0], home[:0]
    n, r = roots(np.concatenate(a), np.concatenate(b))
    return n[n != r], r[n != r]


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """fps: fp, long. Links a-b between different fingerprints that connect exactly those that chains
    of differences of `bits` (3 at most) connect."""
    if not 0 <= bits <= 3:
        raise ValueError("the anchors cover differences of 0 to 3 bits")
    distinct = written(fps.select("fp").where("fp is not null").distinct())
    # Spark takes these for as small as the fingerprints that they are made of; unhinted it would broadcast millions of replicas
    homes, replicas = _replicated(distinct, True).hint("merge"), _replicated(distinct, False).hint("merge")
    dense = written(homes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > DENSE))
    near = F.bit_count(F.col("h").bitwiseXOR(F.col("fp"))) <= bits
    plain = homes.join(dense, "key", "left_anti").select("key", F.col("fp").alias("h")).hint("merge").join(replicas, "key").where((F.col("h") != F.col("fp")) & near).select(F.col("h").alias("a"), F.col("fp").alias("b"))
    # a dense home's rows: each home is dealt to a row of the grid, each replica to a column
    crowd = replicas.join(dense, "key")
    grid = crowd.groupBy("key").agg(F.ceil(F.first("n") / BLOCK).cast("int").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("cols"))
    of = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    left = homes.join(grid, "key").select("key", "fp", of(F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(True).alias("home"))
    right = replicas.join(grid, "key").select("key", "fp", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), of(F.col("cols")).alias("j"), F.lit(False).alias("home"))

    def block(table: pa.Table) -> pa.Table:
        fp, home = table.column("fp").to_numpy(), table.column("home").to_numpy()
        a, b = forest(fp[home], fp[~home], bits)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = left.union(right).groupBy("key", "i", "j").applyInArrow(block, "a long, b long")
    return plain.union(blocks)


def near_duplicates(docs: DataFrame, text: str = "text", by: str = "doc_id", n: int = 3, bits: int = 3) -> DataFrame:
    """For each row its `by`, fp and component_id: the smallest `by` that chains of near fingerprints
    reach. Every row of docs returns once."""
    rows = written(fingerprints(docs, [by], text, n))
    root = components(links(rows, bits))
    each = rows.groupBy("fp").agg(F.min(by).alias("least"))
    named = written(each.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # written, so that the join has two plain exchanges, which are split where a component has very many fingerprints
    whole = written(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return rows.join(named.join(whole, "root").select("fp", "component_id"), "fp")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
