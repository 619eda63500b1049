"""Communities of a weighted graph by modularity, in supersteps: every node reads its neighbours' communities, the best
move of each is found by joins and aggregates, and hashed coins of communities decide which of them nodes may leave and
which they may join, so that neighbours don't change places. Then communities become the nodes of the next graph. Edges and labels never reach the driver;
it gets a few totals a step. Leiden's variant refines communities to well-connected parts before they become nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

METHODS = ("louvain", "leiden")
#: Supersteps end after IDLE in a row that gain less than this. Graphs are made smaller after COARSE steps, as moves of
#: whole communities gain more than single nodes by then; the last labels are worked over on the first graph.
LEAST_GAIN, IDLE = 1e-3, 3
COARSE, FINE, LEVELS = 8, 10, 12


def _graph(edges: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Edges both ways (a, b, w; a loop counts its weight twice, as both of its ends), nodes (node, k: weight of
    their ends), and the sum of k. edges: a, b, w of each undirected edge, repeats add up."""
    e = edges.select(F.col("a"), F.col("b"), "w").union(edges.select(F.col("b"), F.col("a"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    e = cut(e.repartition("b"))
    nodes = cut(e.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")))
    return e, nodes, nodes.agg(F.sum("k")).first()[0] or 0.0


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of a partition (node, label) of undirected edges (a, b, w): one row reaches the driver."""
    e, nodes, total = _graph(edges)
    inner = e.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la = lb").agg(F.sum("w")).first()[0] or 0.0
    held = nodes.join(labels, "node").groupBy("label").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return inner / total - resolution * held / total**2 if total else 0.0


def _step(e: DataFrame, state: DataFrame, total: float, resolution: float, step: int, seed: int, kind: str = "grow") -> tuple[DataFrame, float]:
    """The state (node, k, label, within) after one superstep, and the modularity before it. grow: a hashed coin of each
    community says whether its nodes may leave it or others may join it, so what a node joins is still there. It joins the
    neighbouring community of largest gain among those, ties to the lesser label. within: a community that moves may not
    leave, or null. refine: as grow, but only nodes that are alone may move, which keeps what they join in one piece. fine:
    the coins are the nodes', for communities that are large next to them."""
    tot = state.groupBy(F.col("label").alias("l")).agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
    other = state.select(F.col("node").alias("b"), F.col("label").alias("l"), F.col("within").alias("lw"))
    loop = F.col("a") == F.col("b")
    near = e.join(other, "b").groupBy("a", "l", "lw").agg(F.sum(F.when(loop, 0.0).otherwise(F.col("w"))).alias("w"), F.sum(F.when(loop, F.col("w")).otherwise(0.0)).alias("loop"))
    row = near.join(state.select(F.col("node").alias("a"), "k", "label", "within"), "a").join(tot, "l")
    stay = F.col("l") == F.col("label")
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(step), F.lit(seed)), F.lit(2))
    gain = F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(stay, F.col("k")).otherwise(0.0)) / total
    allowed = ~stay & F.col("lw").eqNullSafe(F.col("within")) & (coin("a") == 0 if kind == "fine" else (coin("label") == 0) & (coin("l") == 1))
    sums = F.sum(F.when(stay, F.col("w") + F.col("loop")).otherwise(F.col("loop")))
    best = row.groupBy("a").agg(F.max(F.when(allowed, F.struct(gain.alias("gain"), (-F.col("l")).alias("l")))).alias("best"), F.max(F.when(stay, gain)).alias("stay"), sums.alias("inner"))
    joined = state.join(best, F.col("node") == F.col("a"), "left").join(tot.withColumnRenamed("l", "label"), "label")
    # without a neighbour in its own community a node only gives up the weight of the others there
    staying = F.coalesce("stay", -resolution * F.col("k") * (F.col("tot") - F.col("k")) / total)
    moves = F.col("best").isNotNull() & (F.col("best.gain") > staying + 1e-12)
    if kind == "refine":
        moves &= F.col("size") == 1
    new = cut(joined.select("node", "k", F.when(moves, -F.col("best.l")).otherwise(F.col("label")).alias("label"), "within", (F.coalesce("inner", F.lit(0.0))).alias("inner"), (F.col("k") * F.col("tot")).alias("held")))
    inner, held = new.agg(F.sum("inner"), F.sum("held")).first()
    return new.select("node", "k", "label", "within"), (inner or 0.0) / total - resolution * (held or 0.0) / total**2


def _local_moves(e: DataFrame, state: DataFrame, total: float, resolution: float, seed: int, steps: int, kind: str = "grow") -> tuple[DataFrame, float]:
    """The state of best modularity; steps end when some in a row gain next to nothing."""
    best, quality, idle = state, None, 0
    for step in range(steps + 1):  # the last one finds what the one before it has gained
        after, before = _step(e, state, total, resolution, step, seed, kind)
        idle = 0 if quality is None or before > quality + LEAST_GAIN else idle + 1
        if quality is None or before > quality:
            best, quality = state, before
        if idle >= IDLE:
            break
        state = after
    return best, quality


def _refined(e: DataFrame, state: DataFrame, total: float, resolution: float, seed: int, rounds: int = 6) -> DataFrame:
    """Parts of each community that hang together: nodes that are alone join a part that they are linked to and gain by."""
    parts = state.select("node", "k", F.col("node").alias("label"), F.col("label").alias("within"))
    for step in range(rounds):
        parts, _ = _step(e, parts, total, resolution, step, seed + 1, "refine")
    return parts


def find(edges: DataFrame, resolution: float = 1.0, method: str = "louvain", seed: int = 1) -> DataFrame:
    """node, label (a node of its community) of a graph of edges a, b (long), w: an undirected edge once, repeats add up.
    Nodes without edges don't occur. leiden: communities come out connected."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: {', '.join(METHODS)}")
    first, nodes, total = _graph(edges)
    e = first
    found = nodes.select("node", F.col("node").alias("at"))  # original nodes and their nodes in the graph of this level
    state = nodes.select("node", "k", F.col("node").alias("label"), F.lit(None).cast("long").alias("within"))
    best = nodes.select("node", F.col("node").alias("label"))
    for level in range(LEVELS):
        state, _ = _local_moves(e, state, total, resolution, seed + 10 * level, COARSE)
        best = cut(found.join(state.select(F.col("node").alias("at"), "label"), "at").select("node", "label"))
        into = _refined(e, state, total, resolution, seed + 10 * level) if method == "leiden" else state
        into = cut(into.select(F.col("node").alias("at"), F.col("label").alias("new"), (F.col("within") if method == "leiden" else F.col("label")).alias("label")))
        size, before = into.agg(F.count_distinct("new"), F.count("*")).first()
        if size == before:
            break
        found = cut(found.join(into.select("at", "new"), "at").select("node", F.col("new").alias("at")))
        a, b = (into.select(F.col("at").alias(c), F.col("new").alias(f"n{c}")) for c in "ab")
        # both ways already, so ends add up as they are
        e = cut(e.join(a, "a").join(b, "b").groupBy(F.col("na").alias("a"), F.col("nb").alias("b")).agg(F.sum("w").alias("w")).repartition("b"))
        k = e.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
        # a community is named by one of the coming graph's nodes
        name = into.groupBy("label").agg(F.min("new").alias("name"))
        group = into.join(name, "label").select(F.col("new").alias("node"), F.col("name").alias("label")).distinct()
        state = cut(k.join(group, "node").select("node", "k", "label", F.lit(None).cast("long").alias("within")))
    state = nodes.join(best, "node").select("node", "k", "label", F.lit(None).cast("long").alias("within"))
    best = _local_moves(first, state, total, resolution, seed + 10 * LEVELS, FINE, "fine")[0].select("node", "label")
    if method == "louvain":
        return best
    from .spatial import components

    inside = first.join(best.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(best.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la = lb and a < b").select("a", "b")
    return components(inside, nodes.select(F.col("node").alias("barcode"))).select(F.col("barcode").alias("node"), F.col("component").alias("label"))


def named(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, method: str = "louvain", seed: int = 1) -> DataFrame:
    """barcode, label (a string) of the nodes (barcode) of a graph of edges a, b (barcodes of any type), w. Nodes without
    edges are communities of their own."""
    ids = cut(nodes.select("barcode").distinct().withColumn("id", F.monotonically_increasing_id()))
    at = lambda c, i: ids.select(F.col("barcode").alias(c), F.col("id").alias(i))
    e = edges.join(at("a", "i"), "a").join(at("b", "j"), "b").select(F.col("i").alias("a"), F.col("j").alias("b"), "w")
    found = find(cut(e), resolution, method, seed)
    return ids.join(found, F.col("id") == F.col("node"), "left").select("barcode", (F.coalesce("label", "id") + 1).cast("string").alias("label"))
