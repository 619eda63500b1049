"""Statistics of a mapping: how matches overlap, and what each kind of cost adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .blocks import Scores


def top_seeds(scores: DataFrame | Scores, nn: int) -> DataFrame:
    """query, seed: the nn best seeds of each query (score, ties by seed)."""
    if isinstance(scores, Scores):
        return scores.top(nn).select("query", "seed")
    w = W.partitionBy("query").orderBy(F.desc("score"), "seed")
    return scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= nn).select("query", "seed")


def top_overlap(scores: DataFrame | Scores, nn: int = 10) -> DataFrame:
    """a, b, distance: 1 less the Jaccard index of the nn best seeds of two queries (score, ties by seed);
    pairs that share none, at distance 1, are left out. An inverted index makes the pairs."""
    return _overlap(top_seeds(scores, nn))


def _overlap(best: DataFrame) -> DataFrame:
    top = best.withColumn("n", F.count("*").over(W.partitionBy("query")))
    a, b = top.select(F.col("query").alias("a"), "seed", F.col("n").alias("na")), top.select(F.col("query").alias("b"), "seed", F.col("n").alias("nb"))
    m = a.join(b, "seed").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("m"))
    return m.select("a", "b", (1 - F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))).alias("distance"))


def contribution(costs: DataFrame | Scores) -> DataFrame:
    """metric (kind) with dispersion, cv, gini, iqr, range and poc (share of the total) of its scores, by how many pairs have
    each score: pairs of one score are never listed, and only a kind's distinct scores meet."""
    d = costs.distribution() if isinstance(costs, Scores) else costs.groupBy("kind", "score").agg(F.count("*").alias("n"))
    d = cut(d)
    n, v = F.col("n").cast("double"), F.col("score")
    # scores of one value take the ranks after those below
    below = F.sum(n).over(W.partitionBy("kind").orderBy("score")) - n
    m = d.groupBy("kind").agg((F.sum(n * v) / F.sum(n)).alias("m"))
    x = d.withColumn("below", below).join(m, "kind").groupBy("kind").agg(F.sum("n").alias("n"), F.sum(n * v).alias("s"), F.first("m").alias("m"), (F.sum(n * (v - F.col("m")) * (v - F.col("m"))) / (F.sum("n") - 1)).alias("v"), F.sum(v * (n * F.col("below") + n * (n + 1) / 2)).alias("is"), F.max("score").alias("hi"), F.min("score").alias("lo"), F.percentile("score", 0.75, F.col("n")).alias("q3"), F.percentile("score", 0.25, F.col("n")).alias("q1"))
    total = F.sum("s").over(W.partitionBy(F.lit(1)))
    return x.select(F.col("kind").alias("metric"), (F.col("v") / F.col("m")).alias("dispersion"), (F.sqrt("v") / F.col("m")).alias("cv"), (2 * F.col("is") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"), (F.col("q3") - F.col("q1")).alias("iqr"), (F.col("hi") - F.col("lo")).alias("range"), (F.col("s") / total).alias("poc"))


def clusters(scores: DataFrame | Scores, nn: int = 30, h: float = 0.75, k: int | None = None, method: str = "hclust", resolution: float = 1.0) -> DataFrame:
    """query, cluster by complete-linkage clustering cut at h of the range, or into k, for which the matrix of the chosen
    queries is on the driver; or by louvain or leiden on overlaps. Neither of these nor a cut at h needs more than the
    pairs of queries that share seeds, and nothing of those reaches the driver."""
    import numpy as np

    spark = scores.query.sparkSession if isinstance(scores, Scores) else scores.sparkSession
    if method in ("louvain", "leiden"):
        from .communities import named

        best = cut(top_seeds(scores, nn))
        edges = _overlap(best).select("a", "b", (1 - F.col("distance")).alias("w")).where("w > 0")
        return named(edges, best.select(F.col("query").alias("barcode")), resolution, method).select(F.col("barcode").alias("query"), F.col("label").alias("cluster"))
    if method != "hclust":
        raise ValueError(f"unknown clustering {method!r}: hclust, louvain, leiden")
    best = cut(top_seeds(scores, nn))
    if k is None:
        return _cut_at(best, h)
    names = sorted(r[0] for r in best.select("query").distinct().collect())
    at = {n: i for i, n in enumerate(names)}
    d = np.ones((len(names), len(names)))
    np.fill_diagonal(d, 0)
    for r in _overlap(best).toLocalIterator():
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["distance"]
    label = complete_linkage(d, (h * (d.max() - d.min())) + d.min(), k)
    return spark.createDataFrame([(n, str(c + 1)) for n, c in zip(names, label, strict=True)], "query string, cluster string" if isinstance(names[0], str) else "query long, cluster string")


def _cut_at(best: DataFrame, h: float) -> DataFrame:
    """Complete linkage of queries by their best seeds (query, seed), cut at h of the range. Queries of the same seeds are one
    from the start (distance 0). Nothing farther apart than the cut is ever merged, so parts that pairs within it link are
    clustered on their own, each from those pairs alone."""
    from .spatial import components

    kind = best.schema["query"].dataType.simpleString()
    sets = best.groupBy("query").agg(F.array_sort(F.collect_list("seed")).alias("seeds"))
    first = sets.groupBy("seeds").agg(F.min("query").alias("first"))
    member = cut(sets.join(first, "seeds").select("query", "first"))
    nodes = cut(first.select(F.col("first").alias("barcode")))
    pairs = cut(_overlap(best.join(nodes.select(F.col("barcode").alias("query")), "query", "left_semi")))
    n = nodes.count()
    have = pairs.agg(F.count("*").alias("n"), F.max("distance").alias("far")).first()
    height = h * (1.0 if have["n"] < n * (n - 1) // 2 else have["far"] or 0.0)
    near = cut(pairs.where(F.col("distance") <= height))
    part = components(near.select("a", "b"), nodes)
    edges = near.join(part.select(F.col("barcode").alias("a"), "component"), "a")

    def linked(f):
        import pandas as pd

        found = sparse_linkage(zip(f["a"], f["b"], f["distance"], strict=True))
        return pd.DataFrame({"first": list(found), "least": list(found.values())})

    found = edges.select("component", "a", "b", "distance").groupBy("component").applyInPandas(linked, f"first {kind}, least {kind}")
    each = cut(member.join(found, "first", "left").select("query", F.coalesce("least", "first").alias("least")))
    number = each.select("least").distinct().withColumn("cluster", F.row_number().over(W.orderBy("least")).cast("string"))
    return each.join(number, "least").select("query", "cluster")


def sparse_linkage(pairs) -> dict:
    """The least member of each member's cluster: complete linkage of (a, b, distance), where pairs that are not given never
    merge. Ties go to the least members, as in complete_linkage."""
    import heapq

    near: dict = {}
    for a, b, d in pairs:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = d
    heap = [(d, a, b) for a, x in near.items() for b, d in x.items() if a < b]
    heapq.heapify(heap)
    members = {a: [a] for a in near}
    while heap:
        d, a, b = heapq.heappop(heap)
        if a not in members or b not in members or near[a].get(b) != d:
            continue
        members[a] += members.pop(b)
        mine, other = near.pop(a), near.pop(b)
        for x in set(mine) | set(other):
            if x not in (a, b):
                near[x].pop(a, None), near[x].pop(b, None)
        near[a] = {x: max(d, other[x]) for x, d in mine.items() if x in other}
        for x, d in near[a].items():
            near[x][a] = d
            heapq.heappush(heap, (d, min(a, x), max(a, x)))
    return {x: a for a, m in members.items() for x in m}


def complete_linkage(d, height: float, k: int | None = None) -> list[int]:
    import numpy as np

    n = len(d)
    groups = {i: [i] for i in range(n)}
    m = d.astype(float).copy()
    np.fill_diagonal(m, np.inf)
    while len(groups) > max(1, k or 1):
        i, j = divmod(int(m.argmin()), n)
        if k is None and m[i, j] > height or not np.isfinite(m[i, j]):
            break
        i, j = min(i, j), max(i, j)
        groups[i] += groups.pop(j)
        m[i] = m[:, i] = np.maximum(m[i], m[j])
        m[j] = m[:, j] = m[i, i] = np.inf
    label = [0] * n
    for c, (_, members) in enumerate(sorted(groups.items())):
        for x in members:
            label[x] = c
    return label
