"""Components and greedy independent sets of graphs given as edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; a component is named by its smallest node.

    Large-star and small-star rounds: each node links its larger neighbours to its smallest one, then its smaller
    ones; the number of rounds grows with the logarithm of the longest path.  Only minima are aggregated, so a
    node of very many edges is combined before the shuffle.  Null ends and loops are left out; repeated edges
    count once; an empty table gives an empty result."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(e)
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"), F.col("u").alias("self")).where("u > self").select("u", "v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = checkpointed(small)
        before, mark = mark, _mark(e)
        if mark == before:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


#: A round of greedy_merge() that decides less than this part of the nodes looks at chains.
FEW = 8


def _mark(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart: their number and two sums of hashes, in one aggregate."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def greedy_merge(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, survivor): in the order of the nodes, each not yet merged survives and takes its larger neighbours.

    The same as the sequential pass: a node survives iff no smaller neighbour does; a merged one goes to its smallest
    surviving neighbour.  By rounds on the undecided: nodes without undecided smaller neighbours survive and merge
    their neighbours.  Nodes with just one undecided smaller neighbour hang on it in chains, which pointer jumping
    decides in one go by the parity of the distance from a chain's head, so a path takes a number of joins that grows
    with the logarithm of its length.  Null ends and loops are left out; repeated edges count once; an empty table
    gives an empty result."""
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = checkpointed(e)
    nodes = checkpointed(e.select(F.col("a").alias("node")).unionAll(e.select("b")).distinct())
    open_edges, kept = e, None
    while True:
        smaller = open_edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"), F.min("a").alias("up"))
        state = checkpointed(nodes.join(smaller, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("up")).alias("up")))
        undecided, heads = state.agg(F.count("*"), F.count_if(F.col("n") == 0)).first()
        if not undecided:
            break
        now = state.where("n = 0").select("node")
        if heads * FEW < undecided:  # where a round would decide few nodes, chains are what is left
            now = checkpointed(now.unionAll(_on_chains(state)))
        kept = now if kept is None else kept.unionAll(now)
        merged = open_edges.join(now.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        gone = checkpointed(now.unionAll(merged).distinct())
        nodes = nodes.join(gone, "node", "left_anti")
        left, right = gone.withColumnRenamed("node", "a"), gone.withColumnRenamed("node", "b")
        open_edges = checkpointed(open_edges.join(left, "a", "left_anti").join(right, "b", "left_anti"))
        nodes = checkpointed(nodes)
    if kept is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("survivor"))
    taken = e.join(kept.withColumnRenamed("node", "a"), "a", "left_semi").groupBy("b").agg(F.min("a").alias("survivor"))
    return taken.select(F.col("b").alias("node"), "survivor").unionAll(kept.select("node", F.col("node").alias("survivor")))


def _on_chains(state: DataFrame) -> DataFrame:
    """(node) of the survivors among nodes with one smaller neighbour (node, n, up) whose chain of such leads to a head
    that survives: those at an even distance from it.  A chain that leads to an undecided node waits."""
    # root: how far the jumps have come; far: whether the distance to it is odd
    table = state.select("node", F.coalesce("up", "node").alias("root"), F.col("up").isNotNull().alias("odd"), (F.col("n") == 0).alias("head"))
    while True:
        ends = table.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("odd").alias("more"))
        after = checkpointed(table.join(ends, "root").select("node", F.col("next").alias("root"), (F.col("odd") != F.col("more")).alias("odd"), "head", (F.col("root") != F.col("next")).alias("moved")))
        moved = after.where("moved").limit(1).count()
        table = after.drop("moved")
        if not moved:
            break
    heads = table.where("head").select(F.col("node").alias("root"))
    return table.where("not head and not odd").join(heads, "root", "left_semi").select("node").join(state.where("n = 1").select("node"), "node", "left_semi")
