"""Conversation prefix trie by preorder intervals.

A node is a distinct sequence of first turns. Distinct whole conversations are sorted by their turns' digests; each
opens the nodes below what it shares with the one before it, so sums over that order number the nodes in preorder, and
a node's subtree ends where the last conversation that goes through it ends. Numbers of leaves and savings of a
subtree are then differences of running sums at both ends of its interval. No node is compared with another.

Roles and texts count by their MD5 (128 bits); null ones are empty. Turns are taken by turn (nulls first), then role,
then that digest; repeated rows are turns of their own. A null conv_id is a conversation. Empty tables give no nodes.
Other columns than conv_id, turn, role and text are not read. A conversation's digests (16 bytes a turn) and sizes are
one row; its texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .prefix import ranges, running
from .repair import CRC_SQL

#: First turns that a conversation can take from another one, conversations that share such a one, ids in a chunk of ends.
GRAFT, FAMILY, CHUNK = 5, 100, 4096
#: Rows of nodes in an Arrow batch.
ROWS = 20_000


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns (array of digest d, binary, and n_chars) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn"), role.alias("role"), d.alias("d"), F.length(text).cast("long").alias("n_chars"))
    return rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["n_chars"].alias("n_chars"))).alias("turns"))


def grafted(convs: DataFrame) -> DataFrame:
    """convs with the first h turns taken from conversation c - c%100 instead of their own; h: unsigned crc32 of the decimal
    conv_id, modulo 6 (a null one keeps its own). conv_id: integers."""
    convs = written(convs)
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, GRAFT).alias("head"))
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (GRAFT + 1), F.lit(0)).cast("int")
    own = convs.withColumn("h", h).withColumn("__b", F.col("conv_id") - F.col("conv_id") % FAMILY)
    joined = own.join(heads, F.col("__b") == F.col("__base"), "left")
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(first, rest).alias("turns"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shared: turns in common with the row before, -1 for the first of all; opened: nodes opened in this range so far.
    Rows (__p, path, before, then others) are in order; before is the last path of the ranges before, for a range's first row."""
    part, last, opened = None, None, 0
    for batch in batches:
        shared, total = [], []
        for p, path, before in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if p != part:
                part, last, opened = p, before, 0
            if last is None:
                n = -1
            else:
                k = min(len(last), len(path))
                differ = np.frombuffer(last, np.uint8, k) != np.frombuffer(path, np.uint8, k)
                n = (int(differ.argmax()) if differ.any() else k) // 16
            last, opened = path, opened + len(path) // 16 - n
            shared.append(n)
            total.append(opened)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=[*batch.schema.names, "shared", "opened"])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that each distinct conversation goes through. end: places taken once it is in; at: the place of a node
    that it opens; opens: whether it opens a child of the node."""
    names = ["node", "parent", "depth", "n_chars", "n", "least", "at", "end", "opens"]
    for batch in batches:
        col = {k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)}
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), batch.schema.field("least").type, pa.int64(), pa.int64(), pa.int64()]
        out: list[list] = [[] for _ in names]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

        for path, sizes, n, least, shared, end in zip(col["path"], col["sizes"], col["n"], col["least"], col["shared"], col["end"], strict=True):
            turns = len(path) // 16
            key, parent = hashlib.md5(), None
            for d in range(turns + 1):
                if d:
                    key.update(path[16 * d - 16 : 16 * d])
                node = key.digest()
                at = end - (turns - d) if d > shared else None
                for v, x in zip(out, (node, parent, d, sizes[d - 1] if d else 0, n, least, at, end, int(shared <= d < turns)), strict=True):
                    v.append(x)
                parent = node
                if len(out[0]) >= ROWS:
                    yield flush()
                    out = [[] for _ in names]
        yield flush()


def build(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members that end at a node, in chunks of CHUNK consecutive ids (node, chunk, ids joined by commas, ascending);
    and the nodes: node (16 bytes), parent, at and end (preorder places from 0 of the node and of the last one below it),
    depth, n_chars (of the last text), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves (nodes
    without children in the subtree), saved_tokens (summed over the subtree: members less one, times n_chars)."""
    path = F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), "")
    flat = written(convs.select("conv_id", F.unhex(path).alias("path"), F.transform("turns", lambda t: t["n_chars"]).alias("sizes")).withColumn("node", F.unhex(F.md5("path"))))
    # equal conversations become one before anything is sorted or compared
    whole = flat.groupBy("node").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least")).drop("node")
    parted = ranges(whole, F.col("path"))
    ends_of = parted.groupBy("__p").agg(F.max("path").alias("last"))
    first = ends_of.select("__p", F.lag("last").over(W.orderBy("__p")).alias("before"))
    rows = parted.join(first, "__p").select("__p", "path", "before", "sizes", "n", "least").repartition("__p").sortWithinPartitions("__p", "path")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    seqs = written(rows.mapInArrow(_shared, f"{kinds}, shared long, opened long").drop("before"))
    offset = seqs.groupBy("__p").agg(F.max("opened").alias("m")).select("__p", (F.sum("m").over(W.orderBy("__p")) - F.col("m")).alias("offset"))
    placed = seqs.join(offset, "__p").select("path", "sizes", "n", "least", "shared", (F.col("opened") + F.col("offset") - 1).alias("end"))
    kind = convs.schema["conv_id"].dataType.simpleString()
    gone_through = placed.mapInArrow(_nodes, f"node binary, parent binary, depth long, n_chars long, n long, least {kind}, at long, end long, opens long")
    nodes = gone_through.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_chars").alias("n_chars"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.max("at").alias("at"), F.max("end").alias("end"), F.sum("opens").alias("n_children"))
    nodes = written(nodes.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_chars")}))
    summed = written(running(nodes, "at", "leaf", "saved"))
    at_end = summed.select(F.col("at").alias("end"), F.col("run_leaf").alias("to_leaf"), F.col("run_saved").alias("to_saved"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = summed.join(at_end, "end").join(above, "parent", "left").select(
        "node", "parent", "at", "end", "depth", "n_chars", "conv_id", "parent_conv_id", "n_convs", "n_children",
        (F.col("to_leaf") - F.col("run_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("to_saved") - F.col("run_saved") + F.col("saved")).alias("saved_tokens"))
    chunk = F.floor(F.coalesce(F.col("conv_id"), F.lit(0)) / CHUNK)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id"))), lambda x: F.coalesce(x["conv_id"].cast("string"), F.lit(""))), ",")
    ends = flat.select("node", "conv_id", chunk.alias("chunk")).groupBy("node", "chunk").agg(ids.alias("ids"))
    return ends, out


def in_order(ends: DataFrame) -> DataFrame:
    """The chunks of each node together and ascending."""
    return ends.repartition("node").sortWithinPartitions("node", "chunk")


#: Nodes as strings of digests; a subtree is all strings that begin with the node's.
TRIE_SQL = f"""
WITH RECURSIVE
k AS (
  SELECT DISTINCT CAST(conv_id AS VARCHAR) AS k FROM conversations WHERE conv_id IS NOT NULL),{CRC_SQL},
t AS (
  SELECT conv_id, length(text) AS n_chars, d, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, d) AS n
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations)),
c AS (
  SELECT conv_id, coalesce(crc % {GRAFT + 1}, 0) AS h FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN crc ON k = CAST(conv_id AS VARCHAR)),
r AS (
  SELECT c.conv_id, 0 AS own, t.n, t.d, t.n_chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND t.n <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.n, t.d, t.n_chars FROM c JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.n > c.h),
m AS (
  SELECT conv_id, n_chars, row_number() OVER w AS depth, string_agg(d, '') OVER w AS p, count(*) OVER (PARTITION BY conv_id) AS turns FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, n ROWS UNBOUNDED PRECEDING)),
g AS (
  SELECT conv_id, depth, p, n_chars, depth = turns AS ends FROM m
  UNION ALL
  SELECT c.conv_id, 0, '', 0, NOT EXISTS (SELECT 1 FROM m WHERE m.conv_id IS NOT DISTINCT FROM c.conv_id) FROM c),
v AS (
  SELECT p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_chars) AS saved, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ends FROM g GROUP BY p),
u AS (
  SELECT v.*, a.conv_id AS parent_conv_id, (SELECT count(*) FROM v b WHERE b.depth = v.depth + 1 AND left(b.p, length(v.p)) = v.p) AS n_children FROM v LEFT JOIN v a ON v.depth > 0 AND a.p = left(v.p, length(v.p) - 32))
SELECT u.conv_id, u.depth, u.parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
FROM u JOIN (SELECT a.p, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens FROM u a JOIN u b ON left(b.p, length(a.p)) = a.p GROUP BY a.p) s ON s.p = u.p
"""
