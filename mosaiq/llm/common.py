"""What several of the training-data operators share: reading tables, bounded slices of Arrow
batches, memoised word hashes and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker holds as words and arrays at one time.
SLICE_CHARS = 1_500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it in
    spark.checkpoint.dir; where that is unset, a temporary folder in one process, and RuntimeError on a
    cluster, whose executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        root = tempfile.mkdtemp(prefix="mosaiq-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and what follows survives
    the loss of executors. The table goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mosaiq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep:
        atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads again."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _drop(df.sparkSession, folder)


def _release() -> None:
    """Freed memory goes back to the system: workers are used again, and what one stage needed would stay with the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(fn, schema), after which a worker keeps no memory that it doesn't use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()  # what the task before held until it had ended
        try:
            yield from fn(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of an Arrow batch whose texts have about `chars` bytes together (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
    at = 0
    while at < batch.num_rows:
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), chars)))
        part = batch.slice(at, end - at)
        yield part, part.column(part.schema.get_field_index(column)).to_pylist()
        at = end


class Memo(dict):
    """word -> value, made by `fn` when first asked for; emptied when it has `limit` entries."""

    def __init__(self, fn: Callable, limit: int = 300_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        value = self[key] = self.fn(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on whole arrays."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes; of the whole sequence if it is shorter."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _U(0x9E3779B97F4A7C15) + words[i : i + n]
            h ^= h >> _U(29)
        return mix(h + _U(k))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def tokenizer_path(name: str) -> str:
    """The file of a public vocabulary, as the package of vocabularies names it on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
