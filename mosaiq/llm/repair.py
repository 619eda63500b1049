"""Conversation structure repair: the cheapest edits that give a conversation the role grammar `(s?(ua)+)?`.

Costs to the end are worked out backwards over turns and grammar states, then a walk from the start takes, among
the edits that keep to the least cost, the one whose initial is least in ASCII (Delete, Insert, Keep, Rerole). The
costs depend on roles and faults alone, so a conversation is a string of one letter a turn there and equal strings
are worked out once in a worker; texts are read after that, as a stream, when turns are rebuilt.

Rows: conv_id, turn, role, text; other columns are not read. Null roles and texts count as one space, so such a text is
blank and such a role is in no grammar. Rows are taken by turn (nulls first), then role, then the text's SHA-256;
repeated rows are duplicates. A null conv_id is a conversation. A conversation of which no row is left has zeros and no edits. Empty
tables give empty results. A conversation's letters (one byte a turn) and edits are one row; its texts are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Memo, slices, written

#: Costs of the edits, and of a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. NEEDS: the role that comes next (system aside).
NEEDS = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
#: Cheapest insertions that end a conversation in each state.
END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 60


def _kept(letter: str, state: int) -> int | None:
    """The state after a turn is kept, or None: s, u, a are roles' initials."""
    if letter == "s":
        return 1 if state == 0 else None
    return NEXT[state] if letter == NEEDS[state][0] else None


def cheapest(letters: str) -> tuple[int, str]:
    """Least cost and its edits' initials. letters: for each turn s, u, a or o (another role), in capitals if it is
    truncated, x if it must go."""
    costs: list[tuple[int, ...]] = [END]
    for c in reversed(letters):
        after, fee = costs[-1], TRUNCATED * c.isupper()
        now = [DELETE + after[q] for q in range(4)]
        if c != "x":
            for q in range(4):
                to = _kept(c.lower(), q)
                now[q] = min(now[q], REROLE + fee + after[NEXT[q]], _FAR if to is None else fee + after[to])
        for _ in range(3):  # insertions lead on from state to state at one place
            now = [min(now[q], INSERT + now[NEXT[q]]) for q in range(4)]
        costs.append(tuple(now))
    costs.reverse()
    edits, state, at = [], 0, 0
    while at < len(letters) or state in (1, 2):
        left = costs[at][state]
        if at < len(letters):
            c, after = letters[at], costs[at + 1]
            if left == DELETE + after[state]:
                edits.append("D")
                at += 1
                continue
        if left == INSERT + costs[at][NEXT[state]]:
            edits.append("I")
            state = NEXT[state]
            continue
        fee, to = TRUNCATED * c.isupper(), _kept(c.lower(), state)
        keep = to is not None and left == fee + after[to]
        edits.append("K" if keep else "R")
        state, at = to if keep else NEXT[state], at + 1
    return costs[0][0], "".join(edits)


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults put in by the crc32 of `conv_id:turn` (null: one space) modulo 20: 0 drops the row, 1 empties its
    text, 2 takes its .!? away, 3 repeats it, 4 makes its role user. Dropped rows stay as such (`dropped`), so that their
    conversation is known."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), "text", kind.alias("kind"))
    r = r.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), (F.col("kind") == 0).alias("dropped"), F.col("role").alias("was_role"), text.alias("was"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    order = F.struct("turn", "was_role", F.sha2("was", 256).alias("was"))
    return r.withColumn("order", order).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("conv_id", "turn", "role", "text", "dropped", "order")


def faults(rows: DataFrame) -> DataFrame:
    """rows with at (place in the conversation, from 1), fault (blank, duplicate, truncated or null) and letter, written.
    rows: as damaged() gives them; `dropped` and `order` may be missing. One exchange, by conversation."""
    if "order" not in rows.columns:
        whole = lambda c: F.coalesce(c, F.lit(" "))
        rows = rows.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"), F.lit(False).alias("dropped")).withColumn("order", F.struct("turn", "role", F.sha2("text", 256).alias("text")))
    here = W.partitionBy("conv_id")
    rows = rows.withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("at", F.row_number().over(here.orderBy("dropped", "order")))
    seen = F.row_number().over(W.partitionBy("conv_id", "same").orderBy("at")) > 1
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", "blank").when(seen, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    letter = F.when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return written(rows.withColumn("fault", F.when(~F.col("dropped"), fault)).withColumn("initial", initial).select("conv_id", "at", "turn", "role", "text", "dropped", "initial", "fault", F.when(~F.col("dropped"), letter).alias("letter")))


def summaries(found: DataFrame) -> DataFrame:
    """Of each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' initials), written."""
    held = found.where("not dropped")
    pair = F.concat(F.lag("initial").over(W.partitionBy("conv_id").orderBy("at")), "initial")
    # conversations of which nothing is left come in as a row without a place
    gone = found.where("dropped").select("conv_id").distinct().withColumns({"turn": F.lit(None).cast(found.schema["turn"].dataType), "fault": F.lit(None).cast("string"), "illegal": F.lit(False), "t": F.lit(None).cast("struct<at:int,letter:string>")})
    each = held.select("conv_id", "turn", "fault", (~pair.isin("su", "ua", "au")).alias("illegal"), F.struct("at", "letter").alias("t"))
    count = lambda c: F.count(F.when(c, 1))
    s = each.unionByName(gone).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["letter"]), "").alias("letters"))
    names = [*s.columns[:-1], "cost", "audit"]
    memo_size = 100_000

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(cheapest, memo_size)
        for batch in batches:
            got = [memo[x] for x in batch.column(batch.num_columns - 1).to_pylist()]
            memo.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema.fields[:-1]) + ", cost long, audit string"
    return written(s.mapInArrow(work, schema))


def rebuilt(found: DataFrame, summary: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, at (from 1), role, text, edit (Keep, Rerole or Insert). A conversation's rows lie
    together and in order. Its edits come first in the stream and its texts after them, so it is not held in memory."""
    lead = summary.select("conv_id", F.lit(0).alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = lead.unionByName(found.where("not dropped").select("conv_id", "at", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    kind = found.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "at", "role", "text", "edit"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, step, state, n = None, "", 0, 0, 0
        out: list[tuple] = []

        def insert() -> None:
            nonlocal step, state, n
            while step < len(audit) and audit[step] == "I":
                n += 1
                out.append((conv, n, NEEDS[state], "", "Insert"))
                step, state = step + 1, NEXT[state]

        for whole in batches:
            for batch, texts in slices(whole, "text"):
                for c, at, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, strict=True):
                    if at == 0:
                        conv, audit, step, state, n = c, text, 0, 0, 0
                        insert()
                        continue
                    edit = audit[step]
                    step += 1
                    if edit != "D":
                        role = role if edit == "K" else NEEDS[state]
                        state, n = (_kept(role[0], state) if edit == "K" else NEXT[state]), n + 1
                        out.append((c, n, role, text, "Keep" if edit == "K" else "Rerole"))
                    insert()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()))], names=names)
                out.clear()

    return rows.mapInArrow(work, f"conv_id {kind}, at long, role string, text string, edit string")


def turn_text() -> Column:
    return F.concat("role", F.lit(":"), "text")


#: crc32 of a short text, bit by bit; costs and walks as recursions over the distinct strings of letters.
CRC_SQL = """
z AS (
  SELECT 1 AS i, k, 4294967295::BIGINT AS c FROM k
  UNION ALL
  SELECT i + 1, k, list_reduce(list_concat([xor(c, CAST(ascii(substr(k, i, 1)) AS BIGINT))], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) FROM z WHERE i <= length(k)),
crc AS (
  SELECT k, xor(c, 4294967295) AS crc FROM z WHERE i = length(k) + 1)"""
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
REPAIR_SQL = f"""
WITH RECURSIVE
k AS (
  SELECT DISTINCT {_KEY} AS k FROM conversations),{CRC_SQL},
o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS was_role, coalesce(text, ' ') AS was, crc.crc % 20 AS kind FROM conversations c JOIN crc ON crc.k = {_KEY}),
h AS (
  SELECT conv_id, turn, was_role, was, CASE WHEN kind = 4 THEN 'user' ELSE was_role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(was, '[.!?]', '', 'g') ELSE was END AS text
  FROM o, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, was_role, sha256(was)) AS pos FROM h),
f AS (
  SELECT *, substr(role, 1, 1) AS initial, rtrim(text, {_BLANK}) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM n),
g AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM f),
l AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN CASE WHEN initial IN ('s', 'u', 'a') THEN upper(initial) ELSE 'O' END
                 WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS letter FROM g),
c AS (
  SELECT conv_id, string_agg(letter, '' ORDER BY pos) AS p, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM l GROUP BY conv_id),
b AS (
  SELECT DISTINCT p, length(p) + 1 AS i, 0 AS e0, 4 AS e1, 2 AS e2, 0 AS e3 FROM c
  UNION ALL
  SELECT p, i, least(n0, 2 + n2, 4 + n3), least(n1, 2 + n2, 4 + n3), least(n2, 2 + n3), least(n3, 2 + n2)
  FROM (SELECT p, i - 1 AS i,
          least(3 + e0, CASE WHEN x = 'x' THEN 1000000000 ELSE 2 + fee + e2 END, CASE x WHEN 'u' THEN fee + e2 WHEN 's' THEN fee + e1 ELSE 1000000000 END) AS n0,
          least(3 + e1, CASE WHEN x = 'x' THEN 1000000000 ELSE 2 + fee + e2 END, CASE x WHEN 'u' THEN fee + e2 ELSE 1000000000 END) AS n1,
          least(3 + e2, CASE WHEN x = 'x' THEN 1000000000 ELSE 2 + fee + e3 END, CASE x WHEN 'a' THEN fee + e3 ELSE 1000000000 END) AS n2,
          least(3 + e3, CASE WHEN x = 'x' THEN 1000000000 ELSE 2 + fee + e2 END, CASE x WHEN 'u' THEN fee + e2 ELSE 1000000000 END) AS n3
        FROM (SELECT *, lower(substr(p, i - 1, 1)) AS x, CASE WHEN substr(p, i - 1, 1) IN ('S', 'U', 'A', 'O') THEN 1 ELSE 0 END AS fee FROM b WHERE i > 1))),
e AS (
  SELECT p, i, [e0, e1, e2, e3] AS e, substr(p, i, 1) AS letter, lower(substr(p, i, 1)) AS x, CASE WHEN substr(p, i, 1) IN ('S', 'U', 'A', 'O') THEN 1 ELSE 0 END AS fee FROM b),
w AS (
  SELECT p, 1 AS i, 0 AS q, 0 AS step, '' AS edit, 0 AS used, 0 AS was FROM e WHERE i = 1
  UNION ALL
  SELECT p, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN CASE WHEN x = 's' THEN 1 ELSE [2, 2, 3, 2][q + 1] END ELSE [2, 2, 3, 2][q + 1] END, step + 1, edit, i, q
  FROM (SELECT w.p, w.i, w.q, w.step, a.x, CASE WHEN z.e IS NOT NULL AND a.e[w.q + 1] = 3 + z.e[w.q + 1] THEN 'D' WHEN a.e[w.q + 1] = 2 + a.e[[3, 3, 4, 3][w.q + 1]] THEN 'I'
          WHEN (a.x = 's' AND w.q = 0 AND a.e[1] = a.fee + z.e[2]) OR (a.x = [ 'u', 'u', 'a', 'u'][w.q + 1] AND a.e[w.q + 1] = a.fee + z.e[[3, 3, 4, 3][w.q + 1]]) THEN 'K' ELSE 'R' END AS edit
        FROM w JOIN e a ON a.p = w.p AND a.i = w.i LEFT JOIN e z ON z.p = w.p AND z.i = w.i + 1 WHERE w.i <= length(w.p) OR w.q IN (1, 2))),
t AS (
  SELECT c.conv_id, string_agg(w.edit, '' ORDER BY w.step) AS audit,
         string_agg(CASE w.edit WHEN 'K' THEN l.role || ':' || l.text WHEN 'R' THEN [ 'user', 'user', 'assistant', 'user'][w.was + 1] || ':' || l.text ELSE [ 'user', 'user', 'assistant', 'user'][w.was + 1] || ':' END, chr(10) ORDER BY w.step) FILTER (WHERE w.edit <> 'D') AS body
  FROM c JOIN w ON w.p = c.p AND w.step > 0 LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.pos = w.used GROUP BY c.conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  CAST(coalesce(b.e0, 0) AS BIGINT) AS cost, coalesce(t.audit, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.p = c.p AND b.i = 1 LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
