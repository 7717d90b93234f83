"""Clustering of graphs and vectors: assignment to hubs, domains, DBSCAN, spectral, k-means, consensus, fallbacks.

Memberships are (node, cluster). Where the order of a greedy method would
matter, the rule is stated without order: best first, ties by name.
"""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.operators import graph, patterns
from tablescape.operators.components import spanning
from tablescape.operators.weights import dependency_weight
from tablescape.session import merged, stage


def best(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The row of the highest score for each ``by``, ties to the least ``tie``."""
    rest = [c for c in df.columns if c not in (*by, score, tie)]
    top = df.groupBy(*by).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"), *rest)).alias("b"))
    return top.select(*by, (-F.col("b.s")).alias(score), F.col("b.t").alias(tie), *[F.col(f"b.{c}").alias(c) for c in rest])


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, weight): undirected, the greatest weight of parallels."""
    e = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight")).where("a <> b")
    return e.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def hub_seeded(edges: DataFrame, hubs: DataFrame, nodes: DataFrame | None = None, first: float = 0.5, second: float = 0.3) -> DataFrame:
    """(node, cluster, stage): every node with a hub, 0 for hubs, 1 for nodes given by their own edges, 2 for components of the rest; unassigned nodes have no cluster.

    Pass 1 takes the hub of the greatest edge weight times dependency weight,
    from ``first`` on. Pass 2 takes whole components of the deferred nodes to
    the community, as pass 1 left it, of the greatest
    0.6 mean weight + 0.25 link density, from ``second`` on.
    """
    all_ = (nodes if nodes is not None else graph.nodes_of(edges)).select("node").distinct()
    h = stage(hubs.select("node").distinct(), "hubs")
    near = both_ways(edges).join(h.select(F.col("node").alias("other")), "other", "left_semi").join(h, "node", "left_anti")
    pairs = dependency_weight(near.select(F.col("node").alias("src"), F.col("other").alias("dst"), "weight"), edges)
    scored = pairs.select(F.col("src").alias("node"), F.col("dst").alias("cluster"), (F.col("weight") * F.col("dependency")).alias("score"))
    one = best(scored, ["node"], "score", "cluster").where(F.col("score") >= first).select("node", "cluster")
    given = stage(h.select("node", F.col("node").alias("cluster"), F.lit(0).alias("stage")).unionByName(one.select("node", "cluster", F.lit(1).alias("stage"))), "given")
    rest = all_.join(given, "node", "left_anti")
    inner = edges.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi")
    comps = rest.join(graph.connected_components(inner), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    comps = stage(comps, "deferred")
    size_c, size_k = comps.groupBy("component").agg(F.count("*").alias("nc")), given.groupBy("cluster").agg(F.count("*").alias("nk"))
    links = both_ways(edges).join(comps, "node").join(given.select(F.col("node").alias("other"), "cluster"), "other").groupBy("component", "cluster").agg(F.avg("weight").alias("w"), F.count("*").alias("n"))
    score = 0.6 * F.col("w") + 0.25 * F.least(F.lit(1.0), F.col("n") / (F.col("nc") * F.col("nk")))
    two = best(links.join(size_c, "component").join(size_k, "cluster").select("component", "cluster", score.alias("score")), ["component"], "score", "cluster").where(F.col("score") >= second)
    late = comps.join(two, "component", "left").select("node", "cluster", F.lit(2).alias("stage"))
    return given.unionByName(late)


def consolidate(membership: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Clusters of less than ``least`` nodes join the large cluster they have most edge weight with, else the largest one; without a large one nothing changes."""
    sizes = stage(membership.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") >= least)
    top = best(large.withColumn("one", F.lit(1)).withColumn("n", F.col("n").cast("double")), ["one"], "n", "cluster").select(F.col("cluster").alias("largest"))
    m = membership.select("node", "cluster")
    links = both_ways(edges).join(m, "node").join(m.select(F.col("node").alias("other"), F.col("cluster").alias("to")), "other").join(large.select(F.col("cluster").alias("to")), "to", "left_semi").where("cluster <> to").groupBy("cluster", "to").agg(F.sum("weight").alias("w"))
    move = best(links, ["cluster"], "w", "to").select("cluster", "to")
    # ``top`` is one row or none
    j = m.join(sizes, "cluster", "left").join(move, "cluster", "left").join(F.broadcast(top), F.lit(True), "left")
    return j.select("node", F.when(F.col("n") < least, F.coalesce("to", "largest", "cluster")).otherwise(F.col("cluster")).alias("cluster"))


def hub_consolidation(edges: DataFrame, hubs: DataFrame, similarities: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, cluster): hubs that belong together, under the one of the highest in-degree less half its out-degree.

    Two hubs belong together with two edges and a similarity above .7, with
    edges both ways and above .6, or as a known pair and above .5; chains of
    such pairs are one group. ``similarities`` and ``known``: (a, b[, similarity]) with a < b.
    """
    h = hubs.select("node")
    e = edges.join(h.select(F.col("node").alias("src")), "src", "left_semi").join(h.select(F.col("node").alias("dst")), "dst", "left_semi").where("src <> dst")
    counts = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), (F.count_if(F.col("src") < F.col("dst")) * F.count_if(F.col("src") > F.col("dst")) > 0).alias("both"))
    s = similarities.select("a", "b", "similarity").join(counts, ["a", "b"], "left").na.fill(0, ["n"])
    if known is not None:
        s = s.join(known.select("a", "b").distinct().withColumn("known", F.lit(True)), ["a", "b"], "left")
    else:
        s = s.withColumn("known", F.lit(False))
    x, f = F.col("similarity"), lambda c: F.coalesce(F.col(c), F.lit(False))
    pairs = s.where(((F.col("n") >= 2) & (x > 0.7)) | (f("both") & (x > 0.6)) | (f("known") & (x > 0.5)))
    pairs = pairs.join(h.select(F.col("node").alias("a")), "a", "left_semi").join(h.select(F.col("node").alias("b")), "b", "left_semi")
    group = h.join(graph.connected_components(pairs, "a", "b"), "node", "left").select("node", F.coalesce("component", "node").alias("group"))
    d = graph.degrees(edges).select("node", (F.col("in_degree") - 0.5 * F.col("out_degree")).alias("score"))
    lead = best(group.join(d, "node", "left").na.fill(0.0, ["score"]).withColumnRenamed("node", "lead"), ["group"], "score", "lead").select("group", F.col("lead").alias("cluster"))
    return group.join(lead, "group").select("node", "cluster")


def structural_domains(membership: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """(cluster, core, hubs, n, confidence): core nodes, hubs that they refer to, and 0.7 internal edge share + 0.3 size score (best from 3 to 15)."""
    core = membership.where("cluster IS NOT NULL").join(hubs.select("node"), "node", "left_anti")
    used = edges.join(core.select(F.col("node").alias("src"), "cluster"), "src").join(hubs.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy("cluster").agg(F.array_sort(F.collect_set("dst")).alias("hubs"))
    c = core.groupBy("cluster").agg(F.array_sort(F.collect_set("node")).alias("core"), F.count("*").alias("k"))
    m = core.select(F.col("node").alias("src"), "cluster").join(edges, "src").join(core.select(F.col("node").alias("dst"), F.col("cluster").alias("cd")), "dst", "left").groupBy("cluster").agg(F.avg((F.col("cluster") == F.coalesce("cd", F.lit(""))).cast("double")).alias("share"))
    j = c.join(used, "cluster", "left").join(m, "cluster", "left").withColumn("hubs", F.coalesce("hubs", F.array()))
    n = F.col("k") + F.size("hubs")
    fit = F.when((n >= 3) & (n <= 15), 1.0).when(n < 3, n / 3).otherwise(15 / n)
    return j.select("cluster", "core", "hubs", n.alias("n"), (0.7 * F.coalesce("share", F.lit(0.0)) + 0.3 * fit).alias("confidence"))


def dependency_score(edges: DataFrame) -> DataFrame:
    """(src, dst, score): 1 a direct edge and 0.5 an indirect one over one node, over the source's edges."""
    e = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = edges.groupBy("src").agg(F.count("*").alias("od"))
    direct = e.select("src", "dst", F.col("n").cast("double").alias("s"))
    indirect = e.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").select("src", "dst", F.lit(0.5).alias("s"))
    return direct.unionByName(indirect).groupBy("src", "dst").agg(F.sum("s").alias("s")).join(out, "src").select("src", "dst", (F.col("s") / F.col("od")).alias("score"))


def dependency_domains(edges: DataFrame, nodes: DataFrame, cohesion: float = 0.6, most: int = 15) -> DataFrame:
    """(cluster, core, supporting, lookup, n, n_consumers, cohesion, coupling, score): a domain for each hub.

    ``nodes`` as ``hubs.dependency_hubs`` gives them. Core nodes are those that
    the hub depends on by composition or core business; supporting ones those
    that core nodes depend on and that matter (importance .6 or centrality
    1.5); lookup ones the references that the hub depends on. Consumers
    depend on the hub and stay out, junctions apart. Cohesion is the share of
    linked pairs among the members, coupling that of linked pairs of members
    and consumers; kept from ``cohesion`` on and up to ``most`` members. Score
    .7 cohesion + .3 (1 - coupling). Self-loops count nothing.
    """
    e = stage(edges.where("src <> dst").select("src", "dst").distinct(), "dependencies")
    kind = nodes.select("node", "node_type", "importance", "centrality", "is_hub")
    kind = stage(kind, "dependency-nodes")
    h = kind.where("is_hub").select(F.col("node").alias("cluster"))
    known = kind.where("is_hub").select(F.col("node").alias("src"), F.col("importance").alias("src_importance"))
    of = lambda c: kind.select(F.col("node").alias(c), F.col("node_type").alias(f"{c}_type"), "importance", "centrality")
    needs = merged(merged(e, known, "src"), of("dst"), "dst")
    is_core = (patterns.relationship_kind(F.col("src"), F.col("dst")) == "composition") | ((F.col("src_importance") >= 0.7) & (F.col("importance") >= 0.7))  # business_nature "core"
    core = stage(needs.where((F.col("dst_type") != "reference") & is_core).select(F.col("src").alias("cluster"), F.col("dst").alias("node")), "core")
    lookup = needs.where("dst_type = 'reference'").select(F.col("src").alias("cluster"), F.col("dst").alias("node"))
    beyond = merged(merged(e, core.withColumnRenamed("node", "src"), "src"), of("dst"), "dst").where("(importance >= 0.6 OR centrality >= 1.5) AND dst_type <> 'reference' AND dst <> cluster")
    supporting = merged(beyond.select("cluster", F.col("dst").alias("node")).distinct(), core, ["cluster", "node"], "left_anti")
    part = lambda df, name: df.select("cluster", "node", F.lit(name).alias("part"))
    members = stage(part(h.withColumn("node", F.col("cluster")), "hub").unionByName(part(core, "core")).unionByName(part(supporting, "supporting")).unionByName(part(lookup, "lookup")), "domain-members")
    consumers = stage(merged(merged(e, h.withColumnRenamed("cluster", "dst"), "dst", "left_semi"), of("src"), "src").where("src_type <> 'junction'").select(F.col("dst").alias("cluster"), F.col("src").alias("node")), "consumers")
    # only domains of a size that is kept go on, so lists are short
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    kept = merged(members, sizes, "cluster")
    near = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()
    legs = stage(merged(kept.select("cluster", "node"), near, "node").select("cluster", "node", "other"), "legs")
    inside = merged(legs, kept.select("cluster", F.col("node").alias("other")), ["cluster", "other"]).groupBy("cluster").agg((F.count("*") / 2).alias("inside"))
    across = merged(legs, consumers.withColumnRenamed("node", "other"), ["cluster", "other"]).groupBy("cluster").agg(F.count("*").alias("across"))
    lists = kept.groupBy("cluster").agg(F.max("n").alias("n"), *[F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("node")))).alias(p) for p in ("core", "supporting", "lookup")])
    j = merged(merged(merged(lists, consumers.groupBy("cluster").agg(F.count("*").alias("n_consumers")), "cluster", "left"), inside, "cluster", "left"), across, "cluster", "left").na.fill(0, ["n_consumers", "inside", "across"])
    n, k = F.col("n"), F.col("n_consumers")
    j = j.withColumn("cohesion", F.when(n <= 1, 1.0).otherwise(F.col("inside") / (n * (n - 1) / 2))).withColumn("coupling", F.when(k == 0, 0.0).otherwise(F.col("across") / (n * k)))
    return j.where(F.col("cohesion") >= cohesion).select("cluster", "core", "supporting", "lookup", "n", "n_consumers", "cohesion", "coupling", (0.7 * F.col("cohesion") + 0.3 * (1 - F.col("coupling"))).alias("score"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, cluster): each round takes the neighbours' label of the greatest weight, ties to the least; a node's own label counts with its mean edge weight, which damps swings."""
    near = stage(both_ways(edges), "lp-edges")
    own = near.groupBy("node").agg(F.avg("weight").alias("w"))
    labels = stage(own.select("node", F.col("node").alias("cluster"), "w"), "lp")
    for _ in range(rounds):
        votes = near.join(labels.select(F.col("node").alias("other"), "cluster"), "other").select("node", "cluster", "weight").unionByName(labels.select("node", "cluster", F.col("w").alias("weight")))
        new = best(votes.groupBy("node", "cluster").agg(F.sum("weight").alias("s")), ["node"], "s", "cluster").select("node", F.col("cluster").alias("new"))
        labels = stage(labels.join(new, "node").select("node", F.col("new").alias("cluster"), "w", (F.col("new") != F.col("cluster")).alias("moved")), "lp")
        if labels.where("moved").isEmpty():
            break
        labels = labels.drop("moved")
    return labels.select("node", "cluster")


def dbscan(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(node, cluster, role) from all pairs (a, b) within reach: core nodes have ``least`` partners; borders go to the least cluster; the rest is noise with a null cluster.

    A cluster is named by its least core node. A pair learns whether its ends
    are core nodes in two joins; of pairs of core nodes those of a partition's
    spanning forest go on, others only to borders, which have few.
    """
    both = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    core = stage(both.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("node"), "core")
    of = lambda end: core.select(F.col("node").alias(end), F.lit(True).alias(f"core_{end}"))
    ends = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").where("core_a OR core_b")
    met = stage(spanning(ends.select("a", "b", (F.col("core_a").isNull() | F.col("core_b").isNull()).alias("whole"))), "met")
    comps = stage(core.join(graph.connected_components(met.where("NOT whole"), "a", "b"), "node", "left").select("node", F.coalesce("component", "node").alias("cluster")), "dbscan")
    sides = met.where("whole").select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.node", "e.other")
    border = sides.join(comps.select(F.col("node").alias("other"), "cluster"), "other").groupBy("node").agg(F.min("cluster").alias("cluster"))
    known = comps.select("node", "cluster", F.lit("core").alias("role")).unionByName(border.select("node", "cluster", F.lit("border").alias("role")))
    return nodes.select("node").join(known, "node", "left").select("node", "cluster", F.coalesce("role", F.lit("noise")).alias("role"))


def consensus(assignments: DataFrame, least: int = 2) -> DataFrame:
    """(pattern, n, nodes): nodes that share their cluster in every clustering of (algo, node, cluster); groups of ``least`` at least."""
    p = assignments.groupBy("node").agg(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws("=", "algo", F.coalesce(F.col("cluster").cast("string"), F.lit("-")))))).alias("pattern"))
    return p.groupBy("pattern").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("node")).alias("nodes")).where(F.col("n") >= least)


def k_means(points: DataFrame, id_: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    """(node, cluster) by Spark's k-means."""
    p = points.select(F.col(id_).alias("node"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")).where("features IS NOT NULL")
    return KMeans(k=k, seed=seed).fit(p).transform(p).select("node", F.col("prediction").alias("cluster"))


def bisecting(points: DataFrame, id_: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    """(node, cluster) by bisecting k-means, the hierarchical clustering that scales."""
    p = points.select(F.col(id_).alias("node"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")).where("features IS NOT NULL")
    return BisectingKMeans(k=k, seed=seed).fit(p).transform(p).select("node", F.col("prediction").alias("cluster"))


def hub_affinity(edges: DataFrame, hubs: DataFrame, membership: DataFrame) -> DataFrame:
    """(hub, cluster, affinity, strength): each hub's best cluster by .35 link density + .25 mean weight + .15 share of its links + .1 relative degree; strong from .7, moderate from .4, weak from .1, else isolated."""
    m = membership.where("cluster IS NOT NULL").join(hubs.select("node"), "node", "left_anti")
    sizes = m.groupBy("cluster").agg(F.count("*").alias("n"))
    legs = both_ways(edges).join(hubs.select("node"), "node", "left_semi")
    total = legs.groupBy("node").agg(F.count("*").alias("all"))
    most = total.agg(F.max("all").alias("most"))
    x = legs.join(m.select(F.col("node").alias("other"), "cluster"), "other").groupBy("node", "cluster").agg(F.count("*").alias("links"), F.avg("weight").alias("w")).join(sizes, "cluster").join(total, "node").crossJoin(F.broadcast(most))
    score = 0.35 * F.col("links") / F.col("n") + 0.25 * F.col("w") + 0.15 * F.col("links") / F.col("all") + 0.1 * F.col("all") / F.col("most")
    b = best(x.select("node", "cluster", score.alias("affinity")), ["node"], "affinity", "cluster")
    out = hubs.select("node").join(b, "node", "left")
    a = F.coalesce("affinity", F.lit(0.0))
    return out.select(F.col("node").alias("hub"), "cluster", a.alias("affinity"), F.when(a >= 0.7, "strong").when(a >= 0.4, "moderate").when(a >= 0.1, "weak").otherwise("isolated").alias("strength"))


def size_buckets(counts: DataFrame, n: str = "n") -> DataFrame:
    """``counts`` with bucket: small up to 5, medium up to 15, large up to 30, huge."""
    return counts.withColumn("bucket", F.when(F.col(n) <= 5, "small").when(F.col(n) <= 15, "medium").when(F.col(n) <= 30, "large").otherwise("huge"))


def chunks(nodes: DataFrame, size: int) -> DataFrame:
    """(node, cluster): a mega-cluster split into buckets of about ``size`` by a hash of the node."""
    k = max(1, -(-nodes.count() // size))
    return nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(k)).alias("cluster"))


def suitable(edges: DataFrame) -> DataFrame:
    """One row: whether a graph is fit for density clustering: edges over nodes at least max(1, .5 ln n), mean weight .3, variance .01."""
    n = graph.nodes_of(edges).agg(F.count("*").alias("n"))
    e = edges.agg(F.count("*").alias("e"), F.avg("weight").alias("mean"), F.var_pop("weight").alias("variance"))
    return n.crossJoin(e).withColumn("suitable", (F.col("e") / F.col("n") >= F.greatest(F.lit(1.0), 0.5 * F.log("n"))) & (F.col("mean") >= 0.3) & (F.col("variance") >= 0.01))  # one row each


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The newest row of each ``by`` (null times first, ties by all columns); combined before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    top = df.groupBy(*by).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return top.select(*by, *[F.col(f"r.{c}").alias(c) for c in [order, *[c for c in rest if c != order]]])


def ranked_top(df: DataFrame, by: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The k highest of each ``by``, ties to the least ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
