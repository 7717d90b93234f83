"""Clusterings that are tried in turn, validated, and the best kept: refinement by resolution, and the cascade down to fallbacks.

Every run is a written table, so a rejected one costs nothing later; what
comes to the driver are scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.operators import clustering, distances, domains, graph, linkage, reach, validation
from tablescape.session import stage

#: Modularity and silhouette below which other resolutions are tried; scores that the first and the second clustering need.
LEAST_MODULARITY, LEAST_SILHOUETTE, FIRST_SCORE, SECOND_SCORE = 0.3, 0.2, 0.6, 0.5


def pair_silhouette(pairs: DataFrame, membership: DataFrame) -> float:
    """Mean silhouette over (a, b, distance), a pair once; a pair that is not listed does not count.

    Clusters of one node are skipped; noise (a null cluster) counts as one more
    cluster, of which no node is scored. 0 without a node to score.
    """
    m = membership.select("node", "cluster")
    of = lambda end: m.select(F.col("node").alias(end), F.col("cluster").alias(f"of_{end}"))
    placed = pairs.select("a", "b", "distance").join(of("a"), "a").join(of("b"), "b")
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(f"of_{a}").alias("cluster"), F.col(f"of_{b}").alias("to"))
    far = placed.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e"), "distance").select("e.*", "distance").where("cluster IS NOT NULL").groupBy("node", "cluster", "to").agg(F.avg("distance").alias("d"))
    sides = far.groupBy("node").agg(F.min(F.when(F.col("cluster") == F.col("to"), F.col("d"))).alias("a"), F.min(F.when(~F.col("cluster").eqNullSafe(F.col("to")), F.col("d"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return sides.agg(F.avg(s)).first()[0] or 0.0


def quality(pairs: DataFrame, edges: DataFrame, membership: DataFrame) -> dict:
    placed = membership.where("cluster IS NOT NULL")
    return {"modularity": validation.modularity(edges, placed).first()[0] or 0.0, "silhouette": pair_silhouette(pairs, membership)}


def _at(level: str, pairs: DataFrame, edges: DataFrame, nodes: DataFrame, runs: dict[str, DataFrame] | None) -> DataFrame:
    """Adaptive DBSCAN at ``level``, written; of ``runs`` where it is known, else kept there."""
    runs = {} if runs is None else runs
    if level not in runs:
        runs[level] = stage(distances.adaptive_dbscan(pairs, edges, nodes, level), "resolution")
    return runs[level]


def refined(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, level: str | None = None, runs: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict]:
    """(node, cluster, role) of adaptive DBSCAN at ``level``, and {level, modularity, silhouette, tried}.

    With a modularity below ``LEAST_MODULARITY`` or a silhouette below
    ``LEAST_SILHOUETTE`` the other resolutions are tried as well, and the
    greatest sum of both is kept, ties with the first. ``runs`` has runs of the
    same pairs by level that are made already.
    """
    level = level or distances.resolution(nodes.count(), graph.density(edges, nodes).first()["density"])
    run = lambda at: _at(at, pairs, edges, nodes, runs)
    best = run(level)
    found = {"level": level, **quality(pairs, edges, best), "tried": 1}
    if found["modularity"] < LEAST_MODULARITY or found["silhouette"] < LEAST_SILHOUETTE:
        for other in [x for x in ("macro", "meso", "micro") if x != level]:
            got = run(other)
            q = quality(pairs, edges, got)
            found["tried"] += 1
            if sum(q.values()) > found["modularity"] + found["silhouette"]:
                best, found = got, found | {"level": other, **q}
    return best, found


def resolutions(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, runs: dict[str, DataFrame] | None = None) -> DataFrame:
    """(node, cluster): nodes that share their cluster at all three resolutions; a cluster has its least node's name, nodes that are noise at one of them, or alone, have none."""
    levels = None
    for level in ("macro", "meso", "micro"):
        got = _at(level, pairs, edges, nodes, runs).select(F.lit(level).alias("algo"), "node", "cluster")
        levels = got if levels is None else levels.unionByName(got)
    sure = levels.groupBy("node").agg(F.count("cluster").alias("n"), F.array_sort(F.collect_list(F.struct("algo", "cluster"))).alias("of")).where("n = 3")  # three a node
    named = sure.groupBy("of").agg(F.min("node").alias("cluster"), F.count("*").alias("n")).where("n > 1")
    return nodes.select("node").join(sure.join(named.drop("n"), "of").select("node", "cluster"), "node", "left")


def graph_shape(edges: DataFrame, nodes: DataFrame) -> dict:
    """What the choice of a fallback asks for: number of components, share of the largest, density, mean degree, variance of weights."""
    m = graph.density(edges, nodes).first()
    comps = nodes.select("node").join(graph.connected_components(edges), "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.count("*").alias("n"))
    c = comps.agg(F.count("*").alias("k"), F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return {"components": c["k"], "largest_share": (c["most"] or 0) / (c["all"] or 1), "density": m["density"] or 0.0, "mean_degree": m["mean_degree"] or 0.0, "weight_variance": edges.agg(F.var_pop("weight")).first()[0] or 0.0}


def fallback(name: str, edges: DataFrame, nodes: DataFrame, k: int | None = None) -> DataFrame:
    """(node, cluster) by the named fallback.

    components: connected components. components_with_singletons: these, and
    nodes alone join the largest. bottom_up: average linkage to ``k`` clusters.
    constraints: components of the edges from the mean weight on. split:
    buckets of 15 by a hash. features: k-means of degrees and mean weight, its
    clusters named by number. ``k``: the root of half the nodes where it is not
    given, 2 at least.
    """
    n = nodes.count()
    k = k or max(2, round((n / 2) ** 0.5))
    comps = lambda e: nodes.select("node").join(graph.connected_components(e), "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    if name == "components":
        return comps(edges)
    if name == "components_with_singletons":
        return clustering.consolidate(stage(comps(edges), "components"), edges, 2)
    if name == "bottom_up":
        return linkage.agglomerated(edges, nodes, k)
    if name == "constraints":
        mean = edges.agg(F.avg("weight").alias("mean"))
        return comps(edges.crossJoin(F.broadcast(mean)).where("weight >= mean").drop("mean"))  # one row
    if name == "split":
        return clustering.chunks(nodes, 15).withColumn("cluster", F.col("cluster").cast("string"))
    if name == "features":
        near = clustering.both_ways(edges).groupBy("node").agg(F.count("*").alias("d"), F.avg("weight").alias("w"))
        rows = nodes.select("node").join(near, "node", "left").na.fill(0)
        return clustering.k_means(rows.select("node", F.array(F.log1p("d"), "w").alias("v")), "node", "v", min(k, max(1, n))).withColumn("cluster", F.col("cluster").cast("string"))
    raise ValueError(f"no fallback {name}")


def structural_score(edges: DataFrame, nodes: DataFrame) -> Callable[[DataFrame], tuple[bool, float]]:
    """A validation: the share of nodes in clusters of two or more, less half the share of the largest beyond one half; valid from .75 of the nodes on."""
    n = max(1, nodes.count())

    def validate(membership: DataFrame) -> tuple[bool, float]:
        r = membership.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").agg(F.sum("n").alias("in"), F.max("n").alias("most")).first()
        covered, most = (r["in"] or 0) / n, (r["most"] or 0) / n
        return covered >= 0.75, covered - 0.5 * max(0.0, most - 0.5)

    return validate


def cascade(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, validate: Callable[[DataFrame], tuple[bool, float]] | None = None, steps: dict[str, Callable[[], DataFrame]] | None = None) -> tuple[DataFrame, list[dict]]:
    """(node, cluster) and what was tried: [{step, valid, score}].

    Consensus of three resolutions; where it is not valid or scores below
    ``FIRST_SCORE``, the refined adaptive clustering; where that is not valid or
    below ``SECOND_SCORE``, the fallback that the graph's shape calls for; of
    these runs the last is kept unless an earlier one scores more. An error in
    a step is recorded with its message and ends in the search around predicted
    settings. ``steps`` replaces steps by name.
    """
    validate = validate or structural_score(edges, nodes)
    runs: dict[str, DataFrame] = {}  # three at most
    made = {
        "multi_resolution": lambda: resolutions(pairs, edges, nodes, runs), "adaptive": lambda: refined(pairs, edges, nodes, "meso", runs)[0],
        "fallback": lambda: fallback(domains.fallback_for(**graph_shape(edges, nodes)), edges, nodes), "predicted": lambda: reach.searched(pairs, nodes)[0],
    } | (steps or {})
    tried: list[dict] = []
    best, top = None, None

    def attempt(name: str) -> tuple[bool, float]:
        nonlocal best, top
        got = stage(made[name]().select("node", "cluster"), "cascade")
        valid, score = validate(got)
        tried.append({"step": name, "valid": valid, "score": score})
        if top is None or score >= top:
            best, top = got, score
        return valid, score

    try:
        valid, score = attempt("multi_resolution")
        if not valid or score < FIRST_SCORE:
            valid, score = attempt("adaptive")
            if not valid or score < SECOND_SCORE:
                attempt("fallback")
    except Exception as error:  # any failure of a step has its own way out, and is told
        tried.append({"step": "error", "valid": False, "score": 0.0, "why": f"{type(error).__name__}: {str(error)[:200]}"})
        attempt("predicted")
    return best, tried
