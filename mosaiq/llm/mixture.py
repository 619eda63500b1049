"""Mixing sources to target weights: words are summed up by source, each source's rate of repetition is its target
over its size, and a document is emitted floor(rate) times and once more if its seeded hash lies below the
fraction. DataFrame functions alone, so all of it runs in the JVM.

The hash is of doc_id, or of the text where that is null, so reruns agree and rows of one doc_id go together. A
fraction's draws miss the target by some documents; of SEEDS seeds each source takes the one whose draws come
nearest, by one more aggregate. A null source is a source, the last one; a null text has no words. Documents without
words take none. Without any words all targets are 0; an empty table gives an empty result. Columns other than
doc_id, text and source are not read, and come back in emit() alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .prefix import positions, running

#: Weights of the sources in order, again and again; the mix's size over that of all documents; the most repetition.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Seeds of which a source takes one.
SEEDS = 32
#: An odd number; draw k is the hash times (k times this number, made odd), modulo 2^32.
STEP = 0x9E3779B1


def n_words(text: Column) -> Column:
    """Runs of other characters than spaces and 0x09 to 0x0D: what is left of them when each becomes one letter and
    white space goes."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", "")).cast("long")


def _hash() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash (32 bits) of each document."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash().alias("hash"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source and source_size to source, source_size and target. Sources share by weight until some reach `most`
    times their size; all others have one level times their weight. The level follows from running sums over the
    sources in the order in which they reach their limits, so no rounds are needed."""
    at = positions(sizes, F.col("source").isNull().asc(), F.col("source").asc(), at="rank")
    kinds = F.array(*[F.lit(w) for w in weights])
    s = at.withColumn("w", F.element_at(kinds, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")).withColumn("limit", F.col("source_size") * most)
    s = running(positions(s.withColumn("full", F.col("limit") / F.col("w")), F.col("full").asc(), F.col("rank").asc(), at="at"), "at", "limit", "w")
    s = written(s)
    all_ = s.agg((F.sum("source_size") * F.lit(share)).alias("goal"), F.sum("w").alias("all_w"))
    # up to and with this source all are at their limits, and the mix still has words left
    reached = s.crossJoin(F.broadcast(all_)).where(F.col("run_limit") + F.col("full") * (F.col("all_w") - F.col("run_w")) <= F.col("goal"))
    last = reached.agg(F.max_by("run_limit", "at").alias("l"), F.max_by("run_w", "at").alias("lw"))
    level = all_.crossJoin(last).select(((F.col("goal") - F.coalesce("l", F.lit(0))) / F.nullif(F.col("all_w") - F.coalesce("lw", F.lit(0)), F.lit(0))).alias("level"))
    return s.crossJoin(F.broadcast(level)).select("source", "source_size", F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("limit").cast("double"))).alias("target"))


def _draw(seed: Column, of: Column | None = None) -> Column:
    """From 0 to below 1, by the row's hash and a seed."""
    return F.pmod((F.col("hash") if of is None else of) * (F.pmod(seed * STEP, F.lit(1 << 30)) * 2 + 1), F.lit(1 << 32)) / float(1 << 32)


def _by_source(docs: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Both sides are plain tables or exchanges, so that a source with very many documents is split."""
    return docs.join(right.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """source, source_size, target, rate, part (the rate's fraction) and seed, written. docs: as sized() gives them."""
    goals = written(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    each = goals.withColumn("rate", F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))).withColumn("part", F.col("rate") - F.floor("rate"))
    # the words that each seed's draws take, for every source in one aggregate
    taken = [F.sum(F.when(_draw(F.lit(k).cast("long")) < F.col("part"), F.col("size")).otherwise(0)) for k in range(seeds)]
    tried = _by_source(docs, each.where("part > 0")).groupBy("source").agg(F.array(*taken).alias("taken"), F.first("part").alias("p"), F.first("source_size").alias("n"))
    off = F.transform("taken", lambda t, k: F.struct(F.abs(t - F.col("p") * F.col("n")).alias("off"), k.cast("long").alias("seed")))
    best = tried.select("source", F.array_min(off)["seed"].alias("seed"))
    return written(_by_source(each, best, "left").withColumn("seed", F.coalesce("seed", F.lit(0).cast("long"))))


def _copies() -> Column:
    return (F.floor("rate") + F.when(_draw(F.col("seed")) < F.col("part"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of each document."""
    docs = written(sized(docs))
    return _by_source(docs, rates(docs, weights, share, most, seeds)).select("doc_id", "source", "size", "source_size", "target", "rate", _copies().alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, all columns, as often as it takes them, with __copy (from 1)."""
    found = rates(written(sized(docs)), **options).select(F.col("source").alias("__s"), F.struct("rate", "part", "seed").alias("__r"))
    drawn = F.floor("__r.rate") + F.when(_draw(F.col("__r.seed"), _hash()) < F.col("__r.part"), 1).otherwise(0)
    return docs.join(found, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__n", drawn.cast("int")).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__s", "__r", "__n")


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS BIGINT) + 1] AS w FROM d GROUP BY source),
f AS (
  SELECT *, CAST({MOST} * n AS DOUBLE) / w AS reach FROM s),
c AS (
  SELECT *, CAST(sum({MOST} * n) OVER o AS BIGINT) AS run_limit, CAST(sum(w) OVER o AS BIGINT) AS run_w, CAST(sum(n) OVER () AS BIGINT) * CAST({SHARE} AS DOUBLE) AS goal, CAST(sum(w) OVER () AS BIGINT) AS all_w
  FROM f WINDOW o AS (ORDER BY reach, source NULLS LAST)),
l AS (
  SELECT (any_value(goal) - coalesce(max(run_limit) FILTER (WHERE ok), 0)) / nullif(any_value(all_w) - coalesce(max(run_w) FILTER (WHERE ok), 0), 0) AS level
  FROM (SELECT *, run_limit + reach * (all_w - run_w) <= goal AS ok FROM c)),
t AS (
  SELECT source, n, least(CAST({MOST} * n AS DOUBLE), coalesce(level * w, CAST({MOST} * n AS DOUBLE))) AS target FROM c, l),
r AS (
  SELECT *, coalesce(target / nullif(n, 0), 0) AS rate, rate - floor(rate) AS part FROM t),
k AS (
  SELECT CAST(k AS BIGINT) AS seed, (k * {STEP}) % {1 << 30} * 2 + 1 AS m FROM range({SEEDS}) g(k)),
x AS (
  SELECT r.source, k.seed, k.m, abs(sum(CASE WHEN (CAST(d.h AS HUGEINT) * k.m) % {1 << 32} / CAST({1 << 32} AS DOUBLE) < r.part THEN d.size ELSE 0 END) - any_value(r.part) * any_value(r.n)) AS off
  FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN k WHERE r.part > 0 GROUP BY r.source, k.seed, k.m),
b AS (
  SELECT source, m FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, seed) AS place FROM x) WHERE place = 1)
SELECT d.doc_id, d.size, r.n AS source_size, r.target,
  CAST(d.size * (floor(r.rate) + CASE WHEN (CAST(d.h AS HUGEINT) * coalesce(b.m, 1)) % {1 << 32} / CAST({1 << 32} AS DOUBLE) < r.part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM r.source
"""
