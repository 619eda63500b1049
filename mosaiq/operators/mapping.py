"""Mapping the cells of one assay on to another's: similarities, their sum as a cost, and assignment.

Similarities are for all pairs of cells by definition. They are computed block by block (blocks): each side is
packed into blocks of cells, and each pair of blocks is one matrix product in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .blocks import Scores, common_counts, common_items, correlation, same, significant
from .spatial import hops, knn_join, radius_join

SIMILARITIES = ("pearson", "pearson_exact", "pearson_fast")
COSTS = ("feature", "niche", "territory", "composition", "cell_type")


def shared_features(seed: DataFrame, query: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Features that both counts have, of those chosen; an error if there are none."""
    out = seed.select("feature").distinct().join(query.select("feature").distinct(), "feature", "left_semi")
    if chosen is not None:
        out = out.join(chosen.select("feature").distinct(), "feature", "left_semi")
    if out.isEmpty():
        raise ValueError("the assays share no feature")
    return out


def dense(counts: DataFrame, cells: DataFrame, features: DataFrame, scale: bool = False) -> DataFrame:
    """barcode, vec: the counts of the features in name order, zeros filled in; with scale z-scores."""
    names = [r[0] for r in features.orderBy("feature").collect()]
    of = counts.where(F.col("feature").isin(names)).groupBy("barcode").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    vec = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.element_at("m", n), F.lit(0.0)))
    out = cells.select("barcode").distinct().join(of, "barcode", "left").select("barcode", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), len(names))).otherwise(vec).alias("vec"))
    if not scale:
        return out
    s = out.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    s = s.agg(F.array_sort(F.collect_list(F.struct("i", "m", "sd"))).alias("s"))
    z = F.transform("vec", lambda v, i: F.when(F.col("s")[i]["sd"] > 0, (v - F.col("s")[i]["m"]) / F.col("s")[i]["sd"]).otherwise(F.lit(0.0)))
    return out.crossJoin(F.broadcast(s)).select("barcode", z.alias("vec"))


def similar(query: DataFrame, seed: DataFrame, method: str = "pearson", digits: int = 5) -> Scores:
    """The scores of `similarity`, made when they are asked for."""
    if method not in SIMILARITIES:
        raise ValueError(f"unknown method {method!r}: {', '.join(SIMILARITIES)}")
    exact = correlation("vec") if method != "pearson" else correlation("vec", lambda n: (n - 1) / n)
    rounded = lambda q, s: (lambda at: lambda i, j: significant(at(i, j), digits))(exact(q, s))
    return Scores(query.select("barcode", "vec"), seed.select("barcode", "vec"), {"score": rounded})


def similarity(query: DataFrame, seed: DataFrame, method: str = "pearson", digits: int = 5) -> DataFrame:
    """query, seed, score of all pairs of vectors (barcode, vec). pearson divides by n where the exact one
    divides by n - 1; undefined ones are 0."""
    return similar(query, seed, method, digits).table().drop("kind")


def jaccard(query: DataFrame, seed: DataFrame, decimals: int | None = None) -> DataFrame:
    """query, seed, score of sets (barcode, items); pairs without common items are left out (score 0)."""
    sets = lambda d: d.select("barcode", F.array_distinct("items").alias("items"))
    return Scores(sets(query), sets(seed), {"score": common_items("items")}, decimals).table().drop("kind")


def neighborhoods(cells: DataFrame, method: str = "knn", k: int = 20, radius: float = 20, depth: int = 1, edges: DataFrame | None = None) -> DataFrame:
    """center, neighbor by knn (self included), radius or graph (edges a, b of the tessellation)."""
    if method == "knn":
        return knn_join(cells, cells, k).select("center", "neighbor")
    if method == "radius":
        return radius_join(cells, cells, radius).select("center", "neighbor")
    if method == "graph":
        if edges is None:
            from .tiling import voronoi

            edges = voronoi(cells).select(F.col("barcode").alias("a"), F.explode("neighbors").alias("b"))
        return hops(edges, cells, depth).select("center", "neighbor")
    raise ValueError(f"unknown neighbourhood {method!r}: knn, radius, graph, territory")


def niche_signal(counts: DataFrame, near: DataFrame) -> DataFrame:
    """feature, barcode, value: the mean over a cell's neighbours, absent rows as 0."""
    sized = near.withColumn("n", F.count("*").over(W.partitionBy("center")))
    return counts.join(sized, F.col("barcode") == F.col("neighbor")).groupBy("feature", F.col("center").alias("barcode")).agg((F.sum("value") / F.first("n")).alias("value"))


def embedding_signal(v: DataFrame, dims: list[int] | None = None) -> DataFrame:
    """feature, barcode, value of embeddings (barcode, vec): a feature for each dimension (from 1), or for those of dims."""
    long = v.select("barcode", F.posexplode("vec").alias("i", "value")).withColumn("i", F.col("i") + 1)
    long = long.where(F.col("i").isin(dims)) if dims else long
    return long.select(F.format_string("dim_%05d", "i").alias("feature"), "barcode", F.col("value").cast("double").alias("value"))


def territory_signal(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """territory, feature, value: the mean over a territory's cells; its cells share it, so none of the
    pairs of cells is made."""
    sizes = cells.groupBy("territory").agg(F.count("*").alias("n"))
    return counts.join(cells.select("barcode", "territory"), "barcode").groupBy("territory", "feature").agg(F.sum("value").alias("s")).join(sizes, "territory").select("territory", "feature", (F.col("s") / F.col("n")).alias("value"))


def composition(cells: DataFrame, near: DataFrame) -> DataFrame:
    """barcode, label, n, size: how often each cell type is among a cell's neighbours."""
    lab = near.join(cells.select(F.col("barcode").alias("neighbor"), F.col("cell_type").alias("label")), "neighbor")
    return lab.groupBy(F.col("center").alias("barcode"), "label").agg(F.count("*").alias("n")).withColumn("size", F.sum("n").over(W.partitionBy("barcode")))


def composition_rows(composed: DataFrame) -> DataFrame:
    """barcode, labels, counts, size: a row for each cell of compositions."""
    c = composed.groupBy("barcode").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("c"), F.max("size").cast("double").alias("size"))
    return c.select("barcode", F.col("c.label").cast("array<string>").alias("labels"), F.col("c.n").alias("counts"), "size")


def composition_jaccard(query: DataFrame, seed: DataFrame, decimals: int | None = None) -> DataFrame:
    """query, seed, score: multiset Jaccard of compositions; pairs without a common label are left out (0)."""
    return Scores(composition_rows(query), composition_rows(seed), {"score": common_counts()}, decimals).table().drop("kind")


#: Pairs of one label that a task makes, about.
PAIRS = 4_000_000


def cell_type_match(query: DataFrame, seed: DataFrame) -> DataFrame:
    """query, seed, score 1 for pairs of one label; all others, at 0, are left out. A label's queries are dealt to as many
    parts as its pairs ask for, and each part meets the label's seeds."""
    q = query.select(F.col("barcode").alias("query"), "cell_type").where("cell_type is not null")
    s = seed.select(F.col("barcode").alias("seed"), "cell_type").where("cell_type is not null")
    sizes = q.groupBy("cell_type").agg(F.count("*").alias("a")).join(s.groupBy("cell_type").agg(F.count("*").alias("b")), "cell_type")
    dealt = cut(sizes.select("cell_type", F.ceil(F.col("a") * F.col("b") / PAIRS).cast("int").alias("parts")))
    n = dealt.agg(F.sum("parts")).first()[0] or 1
    left = q.join(dealt, "cell_type").select("query", "cell_type", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"))
    right = s.join(dealt, "cell_type").select("seed", "cell_type", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    on = ["cell_type", "part"]
    return left.repartition(n, *on).join(right.repartition(n, *on).hint("shuffle_hash"), on).select("query", "seed", F.lit(1.0).alias("score"))


def filter_cost(costs: DataFrame | Scores, threshold: float = 0.3, filter_cells: bool = True) -> DataFrame | Scores:
    """costs (kind, query, seed, score, or Scores) of those queries whose best score of every kind is above the threshold; an
    error if none is. A kind that a query has no row of has best score 0. filter_cells: of cell_type a query needs any match,
    whatever the threshold. Of Scores each query's best ones are found first, and kinds without any go."""
    lazy = isinstance(costs, Scores)
    most = cut(costs.strongest().withColumnRenamed("score", "m")) if lazy else costs.groupBy("query", "kind").agg(F.max("score").alias("m"))
    kinds = most.select("kind").distinct().count()
    bound = F.when(F.col("kind") == "cell_type", 0.0).otherwise(float(threshold)) if filter_cells else F.lit(float(threshold))
    best = most.groupBy("query").agg(F.count("*").alias("have"), F.count(F.when(F.col("m") > bound, 1)).alias("k"), F.max((F.col("kind") == "cell_type").cast("int")).alias("matched"))
    absent = F.lit(kinds) - F.col("have")
    if filter_cells and threshold < 0 and not most.where("kind = 'cell_type'").isEmpty():
        absent = absent - (1 - F.col("matched"))  # no row of cell types is no match
    good = best.where(F.col("k") + (absent if threshold < 0 else F.lit(0)) == kinds).select("query")
    if good.isEmpty():
        raise ValueError(f"no cell has scores above {threshold} of every kind")
    if not lazy:
        return costs.join(good, "query", "left_semi")
    have = {r[0] for r in most.join(good, "query", "left_semi").select("kind").distinct().collect()}
    return costs.of(good.withColumnRenamed("query", "barcode"), [k for k in costs.kinds if k in have])


def total_cost(costs: DataFrame | Scores, kinds: list[str] | None = None, complement: bool = True, decimals: int | None = None) -> DataFrame:
    """query, seed, cost: the sum of 1 - score (or of scores) over the kinds. A kind that a pair lacks has
    score 0, so it costs 1. Pairs without any row are left out; assign_cells' `missing` gives them 1 a kind. Of Scores the
    kinds of a pair are summed where they are made."""
    lazy = isinstance(costs, Scores)
    known = set(costs.kinds) if lazy else {r[0] for r in costs.select("kind").distinct().collect()}
    if kinds:
        if lost := set(kinds) - known:
            raise ValueError(f"unknown cost {sorted(lost)}: {sorted(known)}")
        costs = costs.of(kinds=kinds) if lazy else costs.where(F.col("kind").isin(kinds))
        known = set(kinds)
    if lazy:
        return costs.total(decimals, complement)
    total = F.sum(1 - F.col("score")) + (len(known) - F.count("kind")) if complement else F.sum("score")
    return costs.groupBy("query", "seed").agg((total if decimals is None else F.round(total, decimals)).alias("cost"))


def batches(queries: DataFrame, seeds: DataFrame, size: int, epoch: int) -> tuple[DataFrame, DataFrame, int]:
    """query and seed with batch: both sides in an order hashed by epoch, dealt to equal batches; the
    shorter side is repeated to fill them."""
    nq, ns = queries.count(), seeds.count()
    b = min(max(min(size, ns), min(size, nq)), size)
    n = max(-(-ns // b), -(-nq // b))

    def dealt(df: DataFrame, name: str, have: int) -> DataFrame:
        # the hash's first 12 bits make 4,096 parts, so that no task sorts all rows
        parts = df.select(name, F.xxhash64(name, F.lit(epoch)).alias("h")).withColumn("part", F.shiftright("h", 52))
        before = parts.groupBy("part").agg(F.count("*").alias("m")).select("part", (F.sum("m").over(W.orderBy("part")) - F.col("m")).alias("before"))
        rank = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("h", name)) - 1
        times = -(-n * b // have)
        spread = parts.join(before, "part").select(name, rank.alias("r")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("p", F.col("r") + F.col("t") * have)
        limit = n * b if have < max(nq, ns) else have
        return spread.where(F.col("p") < limit).select(name, (F.floor(F.col("p") / b)).cast("int").alias("batch")).distinct()

    return dealt(queries, "query", nq), dealt(seeds, "seed", ns), n


def epoch_matches(cost: DataFrame | Scores, batch_size: int = 1000, epochs: int = 1, missing: float | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """from, to, cost, epoch: each epoch's batched linear assignments. Missing pairs cost `missing`, or else
    as much as the worst. seeds: all that are on offer (seed), if some have no pair. Of Scores only the pairs within a batch
    are scored, all seeds are on offer, and each kind has a column."""
    if isinstance(cost, Scores):
        cost = Scores(cut(cost.query), cut(cost.seed), cost.kinds, cost.decimals)
        sides = [d.select(F.col("barcode").alias(n)).distinct() for d, n in ((cost.query, "query"), (cost.seed, "seed"))]
        each = [cost.assigned(batches(*sides, batch_size, e)[:2], missing).withColumn("epoch", F.lit(e)) for e in range(1, epochs + 1)]
        return reduce(DataFrame.union, each).withColumnsRenamed({"query": "from", "seed": "to"})
    cost = cut(cost)
    queries, seeds = cost.select("query").distinct(), (cost if seeds is None else seeds).select("seed").distinct()
    kind = cost.schema["query"].dataType.simpleString()
    other = cost.schema["seed"].dataType.simpleString()

    def solve(f):
        import pandas as pd

        from ..functions.numeric import assign

        m = f.pivot_table(index="query", columns="seed", values="cost", aggfunc="min", dropna=False)
        m = m.fillna(m.max().max() if missing is None else missing)
        at = assign(m.to_numpy())
        rows = [(m.index[i], m.columns[j], m.iat[i, j]) for i, j in enumerate(at) if j >= 0]
        return pd.DataFrame(rows, columns=["from", "to", "cost"])

    found = []
    for e in range(1, epochs + 1):
        q, s, _ = batches(queries, seeds, batch_size, e)
        part = q.join(s, "batch").join(cost, ["query", "seed"], "left").select("query", "seed", "batch", "cost") if missing is not None else cost.join(q, "query").join(s, ["seed", "batch"])
        found.append(part.groupBy("batch").applyInPandas(solve, f"from {kind}, to {other}, cost double").withColumn("epoch", F.lit(e)))
    return reduce(DataFrame.union, found)


def assign_cells(cost: DataFrame | Scores, batch_size: int = 1000, epochs: int = 1, missing: float | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """from, to, epoch, cost: for each query the seed of least cost over the epochs of epoch_matches (a
    smaller cost later replaces an earlier one)."""
    return best_match(epoch_matches(cost, batch_size, epochs, missing, seeds))


def cost_by_epoch(matches_of_epochs: DataFrame) -> DataFrame:
    """epoch, cost: the mean cost of what is matched after each epoch, a query's best match so far."""
    w = W.partitionBy("from").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    return matches_of_epochs.groupBy("from", "epoch").agg(F.min("cost").alias("cost")).withColumn("cost", F.min("cost").over(w)).groupBy("epoch").agg(F.avg("cost").alias("cost"))


def best_match(matches: DataFrame) -> DataFrame:
    """Of rows (from, to, cost, epoch) the one of least cost for each from, ties by epoch, then to; other columns stay."""
    rest = [c for c in matches.columns if c not in ("from", "to", "cost", "epoch")]
    return matches.groupBy("from").agg(F.min(F.struct("cost", "epoch", "to", *rest)).alias("b")).select("from", "b.to", "b.epoch", "b.cost", *[f"b.{c}" for c in rest])


def listed(found: DataFrame, kinds: list[str], query: str = "query", seed: str = "seed") -> DataFrame:
    """kind, query, seed, score of rows that have a column for each kind."""
    return found.select(F.col(query).alias("query"), F.col(seed).alias("seed"), *kinds).unpivot(["query", "seed"], kinds, "kind", "score").select("kind", "query", "seed", "score")


def dedupe(matches: DataFrame) -> DataFrame:
    """Rows that are, by cost, the first of their from and the first of their to."""
    order = ["cost", "from", "to"]
    return matches.withColumns({"a": F.row_number().over(W.partitionBy("from").orderBy(*order)), "b": F.row_number().over(W.partitionBy("to").orderBy(*order))}).where("a = 1 and b = 1").drop("a", "b")


def score_matches(matches: DataFrame, costs: DataFrame) -> DataFrame:
    """matches with a column for each kind of score."""
    kinds = sorted(r[0] for r in costs.select("kind").distinct().collect())
    hit = costs.join(matches.select(F.col("from").alias("query"), F.col("to").alias("seed")), ["query", "seed"], "left_semi")
    wide = hit.groupBy(F.col("query").alias("from"), F.col("seed").alias("to")).pivot("kind", kinds).agg(F.first("score"))
    return matches.join(wide, ["from", "to"], "left").fillna(0.0, kinds)


def align(matches: DataFrame, seed_cells: DataFrame, jitter: float = 0) -> DataFrame:
    """barcode, x, y: each query at its seed's place, repeated barcodes made unique by -1, -2, ...; with
    jitter, all but the first at one place are moved by up to that much, by hashes."""
    at = matches.join(seed_cells.select(F.col("barcode").alias("to"), "x", "y"), "to")
    n = F.row_number().over(W.partitionBy("from").orderBy("cost", "to")) - 1
    k = F.row_number().over(W.partitionBy("to").orderBy("cost", "from"))
    out = at.withColumns({"n": n, "k": k})
    move = lambda c, s: F.when(F.col("k") > 1, F.col(c) + (F.pmod(F.xxhash64("from", F.lit(s)), F.lit(20001)) / 10000.0 - 1) * jitter).otherwise(F.col(c))
    name = F.when(F.col("n") > 0, F.concat(F.col("from").cast("string"), F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("from").cast("string"))
    return out.select(name.alias("barcode"), move("x", 1).alias("x"), move("y", 2).alias("y"), "from", "to")


def map_assays(seed_cells: DataFrame, seed_counts: DataFrame, query_cells: DataFrame, query_counts: DataFrame, use_cost=("feature", "niche"), method: str = "pearson", neighborhood: str = "knn", k: int = 20, radius: float = 20, depth: int = 1, batch_size: int = 1000, epochs: int = 1, allow_duplicates: bool = True, threshold: float = 0.3, scale: bool = False, custom: DataFrame | None = None, features: DataFrame | None = None, digits: int = 5, signal: str = "counts", dims: list[int] | None = None, filter_cells: bool = True) -> tuple[DataFrame, DataFrame]:
    """(matches with scores, costs). custom: further scores (kind, query, seed, score). signal: `counts`, or `embeddings`,
    where seed_counts and query_counts are embeddings (barcode, vec) whose dimensions (dims) are the features."""
    if signal not in ("counts", "embeddings"):
        raise ValueError(f"unknown signal {signal!r}: counts, embeddings")
    if signal == "embeddings":
        seed_counts, query_counts = (cut(embedding_signal(v, dims)) for v in (seed_counts, query_counts))
    known = {r[0] for r in custom.select("kind").distinct().collect()} if custom is not None else set()
    if lost := set(use_cost) - set(COSTS) - known:
        raise ValueError(f"unknown cost {sorted(lost)}: {', '.join(COSTS)}")
    if {"feature", "niche", "territory"} & set(use_cost):
        shared = shared_features(seed_counts, query_counts, features)
    exact = {"pearson": lambda n: (n - 1) / n}.get(method, lambda n: 1.0)
    rounded = lambda kind: lambda q, s: (lambda at: lambda i, j: significant(at(i, j), digits))(correlation(kind, exact)(q, s))
    made = {n: rounded(n) for n in ("feature", "niche", "territory")} | {"composition": common_counts(), "cell_type": same("cell_type")}
    if method not in SIMILARITIES:
        raise ValueError(f"unknown method {method!r}: {', '.join(SIMILARITIES)}")

    def side(cells: DataFrame, counts: DataFrame) -> DataFrame:
        """barcode and what the kinds of score read."""
        vec = lambda c, name: dense(c, cells, shared, scale).withColumnRenamed("vec", name)
        out = cells.select("barcode", *["cell_type"] * ("cell_type" in use_cost)).distinct()
        near = neighborhoods(cells, neighborhood, k, radius, depth) if {"niche", "composition"} & set(use_cost) else None
        if "feature" in use_cost:
            out = out.join(vec(counts, "feature"), "barcode")
        if "niche" in use_cost:
            out = out.join(vec(niche_signal(counts, near), "niche"), "barcode")
        if "territory" in use_cost:
            out = out.join(vec(cells.select("barcode", "territory").join(territory_signal(counts, cells), "territory").select("feature", "barcode", "value"), "territory"), "barcode")
        if "composition" in use_cost:
            out = out.join(composition_rows(composition(cells, near)), "barcode", "left")
        return cut(out)

    own = [n for n in COSTS if n in use_cost]
    scores = Scores(side(query_cells, query_counts), side(seed_cells, seed_counts), {n: made[n] for n in own}) if own else None
    full = {"feature", "niche", "territory"} & set(use_cost)
    rest = {} if full else {"missing": float(len(set(use_cost))), "seeds": seed_cells.select(F.col("barcode").alias("seed"))}
    given = [c for c in use_cost if c in known]
    if given:  # scores that are a table of pairs as they come
        frames = ([scores.table()] if own else []) + [custom.where(F.col("kind").isin(given)).select("kind", "query", "seed", "score")]
        costs = cut(filter_cost(cut(reduce(DataFrame.union, frames)), threshold, filter_cells))
        found = assign_cells(total_cost(costs), batch_size, epochs, **rest)
        return score_matches(found if allow_duplicates else dedupe(found), costs), costs
    kept = filter_cost(scores, threshold, filter_cells)
    found = cut(assign_cells(kept, batch_size, epochs, rest.get("missing")))
    matches = found.select("from", "to", "epoch", "cost")
    return score_matches(matches if allow_duplicates else dedupe(matches), listed(found, list(kept.kinds), "from", "to")), kept.table()
