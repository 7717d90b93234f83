"""Hub detection, hub removal and edge-weight normalisation over (src, dst, weight) edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.operators import graph, patterns
from tablescape.session import merged

# By number of nodes below: degree percentile, least degree, betweenness percentile, rank percentile.
SIZES = [(20, 0.90, 2, 0.80, 0.85), (100, 0.85, 3, 0.85, 0.88), (None, 0.98, 5, 0.95, 0.90)]


def hub_scores(edges: DataFrame, nodes: DataFrame | None = None, compat_rank: bool = True) -> DataFrame:
    """(node, degree, betweenness, rank, confidence, is_hub): 0.5, 0.3 and 0.2 for reaching each threshold; a hub from 0.8 on."""
    d = graph.degrees(edges, nodes).select("node", "degree")
    m = d.join(graph.betweenness(edges, nodes), "node").join(graph.pagerank(edges, nodes, compat=compat_rank), "node")
    n = d.count()
    _, p_deg, least, p_between, p_rank = next(s for s in SIZES if s[0] is None or n < s[0])
    limits = m.agg(F.greatest(F.percentile("degree", F.lit(p_deg)), F.lit(float(least))).alias("l_d"), F.percentile("betweenness", F.lit(p_between)).alias("l_b"), F.percentile("rank", F.lit(p_rank)).alias("l_r"))
    when = lambda a, b, w: F.when(F.col(a) >= F.col(b), w).otherwise(0)
    tenths = when("degree", "l_d", 5) + when("betweenness", "l_b", 3) + when("rank", "l_r", 2)
    return m.crossJoin(F.broadcast(limits)).select("node", "degree", "betweenness", "rank", (tenths / 10).alias("confidence"), (tenths >= 8).alias("is_hub"))  # limits: one row


def sigma_hubs(degrees: DataFrame, sigmas: float = 2.5, least: int = 5) -> DataFrame:
    """(node, degree): degree at least ``sigmas`` population deviations above the mean, and ``least``."""
    limit = degrees.agg(F.greatest(F.avg("degree") + sigmas * F.stddev_pop("degree"), F.lit(float(least))).alias("limit"))
    return degrees.crossJoin(F.broadcast(limit)).where("degree >= limit").select("node", "degree")


def dependency_hubs(edges: DataFrame, nodes: DataFrame | None = None, threshold: int = 5, rounds: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """(node, degree, importance, centrality, is_hub, is_root, node_type) of a graph of dependencies.

    A hub has ``threshold`` edges, or a name of importance .8 and three edges,
    or a centrality of 2; a root has a name of importance .7 and two edges
    in. Hubs are of type hub, the others of ``patterns.node_types``.
    """
    d = graph.degrees(edges, nodes)
    c = graph.dependency_centrality(edges, nodes, rounds, tolerance)
    x = merged(d.withColumn("node_type", patterns.node_type(1 << 30)), c, "node").withColumn("importance", patterns.importance(F.col("node").cast("string")))
    hub = (F.col("degree") >= threshold) | ((F.col("importance") >= 0.8) & (F.col("degree") >= 3)) | (F.col("centrality") >= 2)
    root = (F.col("importance") >= 0.7) & (F.col("in_degree") >= 2)
    return x.select("node", "degree", "importance", "centrality", hub.alias("is_hub"), root.alias("is_root"), F.when(hub, "hub").otherwise(F.col("node_type")).alias("node_type"))


def extreme_edges(edges: DataFrame, k: int = 5) -> DataFrame:
    """(kind, src, dst, weight): the ``k`` strongest and the ``k`` weakest edges, ties by name."""
    top = lambda kind, order: edges.orderBy(order, "src", "dst").limit(k).select(F.lit(kind).alias("kind"), "src", "dst", "weight")
    return top("strongest", F.desc("weight")).unionByName(top("weakest", F.asc("weight")))


def hub_type(columns: DataFrame, connections: DataFrame) -> DataFrame:
    """(node, hub_type, hub_score, is_hub) by the highest of the lookup, junction, master and audit scores, ties in this order.

    ``columns``: (node, n_columns, n_fk, n_pk, has_time); ``connections``:
    (node, weight, kind) with kind one-to-many, many-to-one or many-to-many.
    """
    c = connections.groupBy("node").agg(F.count("*").alias("degree"), F.count_if(F.col("kind") == "one-to-many").alias("o2m"), F.count_if(F.col("kind") == "many-to-many").alias("m2m"), F.count_if(F.col("weight") >= 0.5).alias("strong"))
    x = columns.join(c, "node", "left").na.fill(0, ["degree", "o2m", "m2m", "strong"])
    add = lambda *terms: sum((F.when(t, w).otherwise(0) for t, w in terms[1:]), F.when(terms[0][0], terms[0][1]).otherwise(0)) / 10
    cols, fk, pk, d = F.col("n_columns"), F.col("n_fk"), F.col("n_pk"), F.col("degree")
    scores = {
        "lookup": add(((cols < 10) & (d > 10), 4), (F.col("o2m") > d * 0.8, 3), (fk <= 1, 3)),
        "junction": add(((fk >= 2) & (fk / cols > 0.5), 5), (F.col("m2m") > 0, 3), (cols <= 5, 2)),
        "master": add(((cols > 20) & (d > 15), 4), (F.col("o2m") > d * 0.6, 3), ((pk == 1) & (fk <= 2), 3)),
        "audit": add((F.col("has_time"), 3), ((d > 20) & (cols < 15), 4), (F.col("strong") == 0, 3)),
    }
    best = F.greatest(*scores.values())
    kind = None
    for name, s in scores.items():
        kind = F.when(s == best, name) if kind is None else kind.when(s == best, name)
    return x.select("node", kind.alias("hub_type"), best.alias("hub_score"), (best > 0.5).alias("is_hub"))


def keep_top_per_hub(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """The strongest edges of each hub: junction 5 or 30 %, lookup 10 or 20 %, master 15 or 25 %, others 8 or 15 %, the lesser.

    ``edges`` (hub, other, weight), ``hubs`` (hub, hub_type). Ties by the other end's name.
    """
    w = Window.partitionBy("hub")
    r = edges.join(hubs, "hub").withColumn("at", F.row_number().over(w.orderBy(F.desc("weight"), "other"))).withColumn("n", F.count("*").over(w))
    pick = lambda k, p: F.least(F.lit(k), F.ceil(F.col("n") * p))
    most = F.when(F.col("hub_type") == "junction", pick(5, 0.3)).when(F.col("hub_type") == "lookup", pick(10, 0.2)).when(F.col("hub_type") == "master", pick(15, 0.25)).otherwise(pick(8, 0.15))
    return r.where(F.col("at") <= most).drop("at", "n")


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges once, with the greatest weight: (a, b, weight), a < b."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight"))


def mediated_pairs(edges: DataFrame, hubs: DataFrame, factor: float = 0.8) -> DataFrame:
    """(a, b, weight): pairs of non-hubs that share a hub and no edge, ``factor`` times the lesser weight, the best over hubs.

    A pair's hub is a hub, of which there are few, and a hub's edges are
    limited by ``keep_top_per_hub`` before this where they are many.
    """
    h = hubs.select(F.col("node").alias("hub"))
    both = edges.select(F.col("src").alias("hub"), F.col("dst").alias("other"), "weight").unionByName(edges.select(F.col("dst").alias("hub"), F.col("src").alias("other"), "weight"))
    legs = both.join(h, "hub", "left_semi").join(h.select(F.col("hub").alias("other")), "other", "left_anti").groupBy("hub", "other").agg(F.max("weight").alias("weight"))
    pairs = legs.select("hub", F.col("other").alias("a"), F.col("weight").alias("wa")).join(legs.select("hub", F.col("other").alias("b"), F.col("weight").alias("wb")), "hub").where("a < b")
    best = pairs.groupBy("a", "b").agg(F.max(F.least("wa", "wb") * factor).alias("weight"))
    return best.join(canonical(edges).select("a", "b"), ["a", "b"], "left_anti")


def normalised(edges: DataFrame, component: bool = False) -> DataFrame:
    """Weights scaled to 0.1 to 1 between the least and greatest, of all edges or of their component; 1 where they are equal."""
    if component:
        edges = edges.join(graph.connected_components(edges).withColumnRenamed("node", "src"), "src")
        span = edges.groupBy("component").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
        e = edges.join(span, "component")
    else:
        e = edges.crossJoin(F.broadcast(edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))))
    scaled = F.when(F.col("hi") > F.col("lo"), 0.1 + 0.9 * (F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    return e.withColumn("weight", scaled).drop("lo", "hi", "component")
