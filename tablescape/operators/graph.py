"""Graph operators over an edge table (src, dst[, weight]).

All are joins and aggregates over nodes, edges and states of (source, node);
loops write each round to the shared folder, so lineage stays short and a lost
executor costs a read. Nodes are those of the edges unless a node table is
given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.operators.components import connected_components
from tablescape.session import merged, stage

__all__ = ["adjacency", "betweenness", "bfs", "clustering_coefficient", "connected_components", "cycles", "degrees", "density", "dependency_centrality", "nodes_of", "pagerank", "path_metrics", "shortest_path", "transitivity", "undirected"]


#: Successors of a node in one row, on the mean.
LISTED = 512


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, b) with a < b; self-loops go."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other): distinct neighbours in both directions."""
    u = undirected(edges)
    return u.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(u.select(F.col("b").alias("node"), F.col("a").alias("other")))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, in_degree, out_degree, degree, n_neighbours): degrees count parallel edges, neighbours do not; nodes without edges have 0."""
    # first by unordered pair, so a node with a great many edges is combined before it meets its other ends, and a pair of nodes is held once
    swap, end = F.coalesce(F.col("src") > F.col("dst"), F.lit(False)), lambda node, o, i: F.struct(F.col(node).alias("node"), F.col(o).alias("o"), F.col(i).alias("i"))
    sides = edges.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("b"), swap.alias("swap"))
    pairs = sides.groupBy("a", "b").agg(F.count_if(~F.col("swap")).alias("up"), F.count_if("swap").alias("down"))
    ends = pairs.select(F.explode(F.array(end("a", "up", "down"), end("b", "down", "up"))).alias("e"), F.coalesce((F.col("a") != F.col("b")).cast("bigint"), F.lit(0)).alias("n")).select("e.*", "n")
    out = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("n").alias("n_neighbours"))
    out = out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    if nodes is not None:
        out = merged(nodes.select("node").distinct(), out, "node", "left").na.fill(0)
    return out.select("node", "in_degree", "out_degree", "degree", "n_neighbours")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, others): neighbours in both directions, parallels kept, sorted."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return both.groupBy("node").agg(F.array_sort(F.collect_list("other")).alias("others"))


def density(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, edges / (n (n-1) / 2), mean and population deviation of the degree."""
    d = degrees(edges, nodes)
    return d.agg(F.count("*").alias("n_nodes"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("bigint").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("degree_deviation")).withColumn(
        "density", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1) / 2)).otherwise(F.lit(0.0))
    )


def oriented_triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): every triangle once.

    Edges point from the node of smaller degree (ties by name), so a node of
    very many neighbours starts few wedges; two edges of a wedge meet on their
    common start and close on an edge.
    """
    u = stage(undirected(edges), "pairs")
    deg = u.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    p = u.join(deg.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    swap = F.expr("struct(da, a) > struct(db, b)")
    e = stage(p.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y")), "oriented")
    wedge = e.select("x", F.col("y").alias("y1")).join(e.select("x", F.col("y").alias("y2")), "x").where("y1 < y2")
    closing = u.select(F.col("a").alias("y1"), F.col("b").alias("y2"))
    return wedge.join(closing, ["y1", "y2"]).select(F.col("x").alias("a"), F.col("y1").alias("b"), F.col("y2").alias("c"))


def clustering_coefficient(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, n_neighbours, triangles, coefficient): triangles over possible ones; 0 with less than two neighbours."""
    t = oriented_triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = degrees(edges, nodes).select("node", "n_neighbours")
    n = F.col("n_neighbours")
    return d.join(t, "node", "left").na.fill(0, ["triangles"]).withColumn("coefficient", F.when(n >= 2, F.col("triangles") / (n * (n - 1) / 2)).otherwise(F.lit(0.0)))


def average_clustering(edges: DataFrame) -> DataFrame:
    """One row: the mean coefficient over nodes with two neighbours at least."""
    return clustering_coefficient(edges).where("n_neighbours >= 2").agg(F.coalesce(F.avg("coefficient"), F.lit(0.0)).alias("average"), F.count("*").alias("n"))


def transitivity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, triangles, wedges, transitivity) over the edges within each cluster; ``membership`` is (node, cluster)."""
    m = membership.select("node", "cluster")
    inner = edges.join(m.select(F.col("node").alias("src"), F.col("cluster").alias("cs")), "src").join(m.select(F.col("node").alias("dst"), F.col("cluster").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("cluster"))
    c = clustering_coefficient(inner.select("src", "dst")).join(m, "node")
    n = F.col("n_neighbours")
    return c.groupBy("cluster").agg((F.sum("triangles") / 3).cast("bigint").alias("triangles"), F.sum(n * (n - 1) / 2).cast("bigint").alias("wedges")).withColumn(
        "transitivity", F.when(F.col("wedges") > 0, 3 * F.col("triangles") / F.col("wedges")).otherwise(F.lit(0.0))
    )


def _listed(links: DataFrame, shares: DataFrame) -> DataFrame:
    """(src, share, to), written: the (dst, m) of each ``src`` in lists of about ``LISTED`` at most, so an edge does not repeat its source in every round and a node of very many edges is many rows."""
    part = F.pmod(F.xxhash64("dst"), F.floor(F.col("share") / LISTED) + 1)
    parts = links.join(shares, "src").groupBy("src", "share", part.alias("part")).agg(F.collect_list(F.struct("dst", F.col("m").cast("int").alias("m"))).alias("to"))
    return stage(parts.select("src", "share", "to"), "rank-links")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, compat: bool = False) -> DataFrame:
    """(node, rank). The standard rank spreads the mass of nodes without successors over all and sums to 1.

    ``compat`` divides a node's rank by all its edges, in and out, and spreads
    nothing, so mass leaks. Parallel edges count. Stops when the ranks move by
    less than ``tolerance`` in sum, or after ``rounds``.
    """
    all_ = (nodes if nodes is not None else nodes_of(edges)).select("node").distinct()
    deg = degrees(edges, all_)
    state = stage(deg.select("node", F.col("degree" if compat else "out_degree").alias("share")), "rank-nodes")
    n = state.count()
    if not n:
        return state.select("node", F.lit(0.0).alias("rank"))
    links = _listed(edges.groupBy("src", "dst").agg(F.count("*").alias("m")), state.select(F.col("node").alias("src"), "share"))
    ranks = state.withColumn("rank", F.lit(1.0 / n))
    loose = 0.0 if compat else state.where("share = 0").count() / n
    for _ in range(rounds):
        sent = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").select(F.explode("to").alias("to"), "share", "rank")
        got = sent.groupBy(F.col("to.dst").alias("node")).agg(F.sum(F.col("rank") * (F.col("to.m") / F.col("share"))).alias("got"))
        new = ranks.join(got, "node", "left").select("node", "share", F.col("rank").alias("old"), (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / n))).alias("rank"))
        ranks = stage(new, "rank")
        moved, left = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("share") == 0, F.col("rank"))), F.lit(0.0))).first()
        ranks, loose = ranks.drop("old"), 0.0 if compat else left
        if moved < tolerance:
            break
    return ranks.select("node", "rank")


def dependency_centrality(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """(node, centrality): from 1, 0.15 + 0.85 times the sum of distinct dependents' centrality over their out-degree (parallels counted), until no value moves by ``tolerance``."""
    all_ = (nodes if nodes is not None else nodes_of(edges)).select("node").distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("od"))
    links = stage(merged(edges.select("src", "dst").distinct(), out, "src"), "central-links")
    c = stage(all_.withColumn("centrality", F.lit(1.0)), "central")
    for _ in range(rounds):
        got = merged(links, c.select(F.col("node").alias("src"), "centrality"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("centrality") / F.col("od")).alias("got"))
        c = stage(merged(c, got, "node", "left").select("node", F.col("centrality").alias("old"), (F.lit(0.15) + F.lit(0.85) * F.coalesce("got", F.lit(0.0))).alias("centrality")), "central")
        moved = c.agg(F.max(F.abs(F.col("centrality") - F.col("old")))).first()[0]
        c = c.drop("old")
        if moved is None or moved < tolerance:
            break
    return c


def bfs(edges: DataFrame, sources: DataFrame, most: int = 50, directed: bool = False) -> DataFrame:
    """(source, node, hops): hop counts from every source (``sources``: source), level by level; unreached nodes have no row.

    Raises if there are nodes more than ``most`` hops away.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).distinct() if directed else neighbours(edges)
    step = stage(step, "bfs-steps")
    seen = stage(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")).distinct(), "bfs")
    for hop in range(1, most + 1):
        front = seen.where(F.col("hops") == hop - 1).join(step, "node").select("source", F.col("other").alias("node")).distinct()
        new = stage(front.join(seen, ["source", "node"], "left_anti").select("source", "node", F.lit(hop).alias("hops")), "bfs")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)  # of written levels: nothing is written twice
    else:
        raise ValueError(f"paths of {most} hops or more: give a larger most")
    return seen


def shortest_path(edges: DataFrame, start, end, most: int = 50) -> DataFrame:
    """(position, node): the nodes of one shortest undirected path; of equal ones the least by names from the end back. Empty if there is none."""
    spark = edges.sparkSession
    hops = bfs(edges, spark.createDataFrame([(start,)], ["source"]), most)
    there = hops.where(F.col("node") == F.lit(end)).select("hops").first()
    if there is None:
        return hops.select(F.col("hops").alias("position"), "node").where("false")
    path, at, step = [(there[0], end)], end, neighbours(edges)
    for hop in range(there[0] - 1, -1, -1):  # one node a hop
        at = step.where(F.col("node") == F.lit(at)).select(F.col("other").alias("node")).join(hops.where(F.col("hops") == hop), "node").agg(F.min("node")).first()[0]
        path.append((hop, at))
    return spark.createDataFrame(path, ["position", "node"])


def path_metrics(edges: DataFrame, sources: DataFrame | None = None, most: int = 50) -> DataFrame:
    """One row: diameter and mean length of the shortest paths from ``sources`` (all nodes if None)."""
    all_ = nodes_of(edges).select(F.col("node").alias("source")) if sources is None else sources
    return bfs(edges, all_, most).where("hops > 0").agg(F.coalesce(F.max("hops"), F.lit(0)).alias("diameter"), F.coalesce(F.avg("hops"), F.lit(0.0)).alias("mean_length"), F.count("*").alias("n_paths"))


def betweenness(edges: DataFrame, nodes: DataFrame | None = None, sources: DataFrame | None = None, most: int = 50) -> DataFrame:
    """(node, betweenness): over undirected distinct edges, normalised by (n-1)(n-2), summed over all sources.

    Brandes' recurrences as joins: path counts go forward level by level for
    all sources at once, dependencies come back. ``sources`` restricts the
    sum (an estimate), so the states (source, node) stay within bounds on
    large graphs.
    """
    all_ = (nodes if nodes is not None else nodes_of(edges)).select("node").distinct()
    n = all_.count()
    step = stage(neighbours(edges), "between-steps")
    start = (all_.select(F.col("node").alias("source")) if sources is None else sources.select("source")).distinct()
    levels = [stage(start.select("source", F.col("source").alias("node"), F.lit(1.0).alias("paths")), "between")]
    seen = levels[0].select("source", "node")
    for _ in range(most):
        new = levels[-1].join(step, "node").groupBy("source", F.col("other").alias("node")).agg(F.sum("paths").alias("paths")).join(seen, ["source", "node"], "left_anti")
        new = stage(new, "between")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("source", "node"))
    else:
        raise ValueError(f"paths of {most} hops or more: give a larger most")
    carried, total = None, None
    for at in range(len(levels) - 1, 0, -1):
        own = levels[at]
        own = own.withColumn("dep", F.lit(0.0)) if carried is None else own.join(carried, ["source", "node"], "left").na.fill(0.0, ["dep"])
        own = stage(own, "between")
        part = own.select("source", "node", "dep")
        total = part if total is None else total.unionByName(part)
        up = own.select("source", F.col("node").alias("other"), ((1 + F.col("dep")) / F.col("paths")).alias("share")).join(step, "other")
        carried = up.join(levels[at - 1], ["source", "node"]).groupBy("source", "node").agg(F.sum(F.col("share") * F.col("paths")).alias("dep"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if total is None:
        return all_.withColumn("betweenness", F.lit(0.0))
    return all_.join(total.where("node <> source").groupBy("node").agg((F.sum("dep") * scale).alias("betweenness")), "node", "left").na.fill(0.0, ["betweenness"])


def cycles(edges: DataFrame, most: int = 20) -> DataFrame:
    """(node, length): nodes on a directed cycle with the length of their shortest one; raises if paths are longer than ``most``."""
    e = stage(edges.select("src", "dst").distinct(), "cycle-edges")
    front = e.select(F.col("src").alias("source"), F.col("dst").alias("node"))
    out = front.where("source = node").select(F.col("source").alias("node"), F.lit(1).alias("length"))
    seen = stage(front.distinct(), "cycle")
    front = seen
    for length in range(2, most + 1):
        front = stage(front.join(e.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node").select("source", F.col("to").alias("node")).distinct().join(seen, ["source", "node"], "left_anti"), "cycle")
        if front.isEmpty():
            break
        out = out.unionByName(front.where("source = node").select(F.col("source").alias("node"), F.lit(length).alias("length")))
        seen = seen.unionByName(front)
    else:
        raise ValueError(f"paths of {most} edges or more: give a larger most")
    return out.groupBy("node").agg(F.min("length").alias("length"))
