"""Distances between tables of a catalog, adaptive DBSCAN on them, and merging of small components.

Pairs are of tables, so they number the square of a catalog's size; ``within``
keeps only pairs of tables that an edge path or a shared column name brings
near where a catalog is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescape.functions.stats import percentiles_by_index
from tablescape.functions.vectors import distribution_cosine, jaccard, jensen_shannon
from tablescape.operators import clustering, graph
from tablescape.operators.patterns import type_distribution
from tablescape.session import stage

FLAGS = ("is_pk", "is_fk", "is_unique", "is_nullable")


def table_profiles(columns: DataFrame) -> DataFrame:
    """(node, n, flags, kinds, names, types, shares): what distances compare, a row a table."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    p = columns.groupBy(F.col("table_name").alias("node")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(flag(c).cast("double")) for c in FLAGS]).alias("flags"), F.collect_set(F.concat_ws("-", *[flag(c).cast("string") for c in FLAGS])).alias("kinds"),
        F.collect_set(F.lower("column_name")).alias("names"), F.collect_list("type_class").alias("types"),
    )
    return p.join(type_distribution(columns).withColumnRenamed("table_name", "node"), "node")


def density_weights(density: float, mean_degree: float, deviation: float) -> dict[str, float]:
    """Weights of the composite distance: sparse graphs go by connectivity, uneven ones by structure."""
    w = {"structural": 0.3, "connectivity": 0.4, "cardinality": 0.2, "constraint": 0.1}
    if density < 0.01:
        w = {"structural": 0.3, "connectivity": 0.5, "cardinality": 0.15, "constraint": 0.05}
    elif density > 0.1:
        w = {"structural": 0.35, "connectivity": 0.25, "cardinality": 0.25, "constraint": 0.15}
    if deviation > mean_degree:
        w["structural"] += 0.1
        w["connectivity"] -= 0.1
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def _pairs(profiles: DataFrame, within: DataFrame | None) -> DataFrame:
    side = lambda p: profiles.select(*[F.col(c).alias(f"{p}_{c}") for c in profiles.columns])
    if within is not None:
        return within.select(F.col("a").alias("a_node"), F.col("b").alias("b_node")).join(side("a"), "a_node").join(side("b"), "b_node")
    return side("a").join(side("b"), F.col("a_node") < F.col("b_node"))


def composite_distance(columns: DataFrame, edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(a, b, distance), a < b: structure, connectivity, cardinality and constraints, weighted by the graph's density; 0.8 more across components; held to 0 to 1."""
    profiles = stage(table_profiles(columns), "profiles")
    m = graph.density(edges, profiles).first()
    w = density_weights(m["density"], m["mean_degree"] or 0.0, m["degree_deviation"] or 0.0)
    comp = profiles.select("node").join(graph.connected_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    p = _pairs(profiles.join(comp, "node"), within)
    linked = edges.groupBy(F.least("src", "dst").alias("a_node"), F.greatest("src", "dst").alias("b_node")).agg(F.max("weight").alias("weight"))
    p = p.join(linked, ["a_node", "b_node"], "left")
    na, nb = F.col("a_n"), F.col("b_n")
    structural = 0.3 * F.abs(na - nb) / F.greatest(na, nb) + 0.5 * jensen_shannon(F.col("a_shares"), F.col("b_shares")) + 0.2 * (1 - jaccard(F.col("a_kinds"), F.col("b_kinds"), 0.0))
    connectivity = 1 - F.coalesce("weight", F.lit(0.0))
    cardinality = 0.6 * F.log(F.greatest(na, nb) / F.least(na, nb) + 1) / F.log(F.lit(100.0)) + 0.4 * F.abs(F.element_at("a_flags", 2) - F.element_at("b_flags", 2))
    constraint = F.sqrt(F.aggregate(F.zip_with("a_flags", "b_flags", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) / 2
    d = w["structural"] * structural + w["connectivity"] * connectivity + w["cardinality"] * cardinality + w["constraint"] * constraint
    d = d + F.when(F.col("a_component") != F.col("b_component"), 0.8).otherwise(0.0)
    return p.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)).alias("distance"))


def diagram_distance(columns: DataFrame, edges: DataFrame, depth: int = 6) -> DataFrame:
    """(a, b, distance), a < b: .3 no edge + .25 path length (capped at ``depth``) + .2 structure + .15 (1 - neighbours in common) + .1 difference of degrees."""
    profiles = table_profiles(columns)
    near = graph.neighbours(edges).groupBy("node").agg(F.collect_set("other").alias("others"))
    deg = graph.degrees(edges).select("node", "degree")
    x = stage(profiles.join(near, "node", "left").join(deg, "node", "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>"))).na.fill(0, ["degree"]), "profiles")
    hops = graph.bfs(edges, x.select(F.col("node").alias("source")), depth).select(F.col("source").alias("a_node"), F.col("node").alias("b_node"), "hops")
    p = _pairs(x, None).join(hops, ["a_node", "b_node"], "left")
    alike = 0.5 * F.least("a_n", "b_n") / F.greatest("a_n", "b_n") + 0.5 * distribution_cosine(F.col("a_shares"), F.col("b_shares"))
    d = (
        0.3 * F.when(F.col("hops") == 1, 0.0).otherwise(1.0) + 0.25 * F.least(F.coalesce("hops", F.lit(depth)), F.lit(depth)) / depth + 0.2 * (1 - alike)
        + 0.15 * (1 - jaccard(F.col("a_others"), F.col("b_others"), 0.5)) + 0.1 * F.when(F.greatest("a_degree", "b_degree") > 0, F.abs(F.col("a_degree") - F.col("b_degree")) / F.greatest("a_degree", "b_degree")).otherwise(0.0)
    )
    return p.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), d.alias("distance"))


def resolution(n: int, density: float) -> str:
    return "macro" if n < 50 or n > 200 and density < 0.01 else "meso"


def least_points(level: str, n: int, mean_degree: float, deviation: float) -> int:
    """2 to 6 partners that make a core node, by resolution and degrees."""
    base = max(2, int(mean_degree * 0.5))
    points = {"macro": max(2, min(base, 3)), "meso": max(3, min(base + 1, 4)), "micro": max(4, min(base + 2, 5))}[level]
    if n < 50:
        points = min(points, 3)
    if deviation > mean_degree and points > 2:
        points -= 1
    return max(2, min(6, points))


def adaptive_dbscan(distances: DataFrame, edges: DataFrame, nodes: DataFrame, level: str | None = None) -> DataFrame:
    """(node, cluster, role): DBSCAN whose reach is a percentile of the distances (macro 75, meso 50, micro 25), within the middle 80 % of their range."""
    m = graph.density(edges, nodes).first()
    level = level or resolution(m["n_nodes"], m["density"])
    p = percentiles_by_index(distances, "distance", [10, 25, 50, 75, 90]).first()
    if p is None:
        return nodes.select("node", F.lit(None).cast("string").alias("cluster"), F.lit("noise").alias("role"))
    reach = {"macro": p["p75"] * 0.8, "meso": p["p50"], "micro": p["p25"] * 1.2}[level]
    reach = max(p["p10"], min(p["p90"], reach))
    points = least_points(level, m["n_nodes"], m["mean_degree"] or 0.0, m["degree_deviation"] or 0.0)
    return clustering.dbscan(distances.where(F.col("distance") <= reach), nodes, points)


def connection_score(a: str = "a", b: str = "b") -> Column:
    """.5 common column names + .3 common types, over the smaller table, + .2 nearness of sizes."""
    names = F.size(F.array_intersect(f"{a}_names", f"{b}_names")) / F.greatest(F.lit(1), F.least(F.size(f"{a}_names"), F.size(f"{b}_names")))
    types = F.size(F.filter(f"{a}_types", lambda t: F.array_contains(F.col(f"{b}_types"), t))) / F.greatest(F.lit(1), F.least(F.size(f"{a}_types"), F.size(f"{b}_types")))
    return 0.5 * names + 0.3 * types + 0.2 / (1 + F.abs(F.col(f"{a}_n") - F.col(f"{b}_n")) / 10)


def merge_small_components(columns: DataFrame, edges: DataFrame, small: int = 5, least: float = 0.3) -> DataFrame:
    """(src, dst, weight): ``edges`` and one for each component of less than ``small`` tables, to the most like table of the largest component, at .4 of its score."""
    profiles = stage(table_profiles(columns), "profiles")
    comp = stage(profiles.select("node").join(graph.connected_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "comp")
    sizes = comp.groupBy("component").agg(F.count("*").alias("k"))
    main = sizes.orderBy(F.desc("k"), "component").limit(1).select(F.col("component").alias("main"))
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in profiles.columns], *([F.col("component")] if p == "a" else []))
    few = profiles.join(comp, "node").join(sizes.where(F.col("k") < small), "component").join(main, F.col("component") == F.col("main"), "left_anti")
    to = profiles.join(comp.join(main, F.col("component") == F.col("main"), "left_semi").select("node"), "node", "left_semi")
    pairs = side(few, "a").crossJoin(side(to, "b")).select("component", F.col("a_node").alias("src"), F.col("b_node").alias("dst"), connection_score().alias("score"))  # tables of small components by tables
    top = pairs.groupBy("component").agg(F.min(F.struct((-F.col("score")).alias("s"), "src", "dst")).alias("t")).where(-F.col("t.s") >= least)
    return edges.select("src", "dst", "weight").unionByName(top.select("t.src", "t.dst", (-F.col("t.s") * 0.4).alias("weight")))


def without_hubs(edges: DataFrame, hubs: DataFrame, most: int = 10) -> DataFrame:
    """(src, dst, weight): ``edges`` without those of hubs, and pairs that a hub mediates.

    A hub of up to 5 edges gives pairs of its three strongest with weights
    above .8, at .5 of the lesser; others pairs of neighbours in the order of
    their strongest tenth (5 at most) above .7, at .4; ``most`` a hub.
    """
    from pyspark.sql.window import Window

    h = hubs.select("node")
    legs = clustering.both_ways(edges).join(h, "node", "left_semi").join(h.select(F.col("node").alias("other")), "other", "left_anti")
    w = Window.partitionBy("node")
    r = legs.withColumn("at", F.row_number().over(w.orderBy(F.desc("weight"), "other"))).withColumn("n", F.count("*").over(w))
    few = F.col("n") <= 5
    r = r.where(F.col("at") <= F.when(few, 3).otherwise(F.least(F.lit(5), F.ceil(F.col("n") * 0.1)))).where(F.col("weight") > F.when(few, 0.8).otherwise(0.7))
    pairs = r.alias("x").join(r.alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.at") < F.col("y.at")) & ((F.col("x.n") <= 5) | (F.col("y.at") == F.col("x.at") + 1)))
    made = pairs.select(F.col("x.node").alias("hub"), F.least("x.other", "y.other").alias("src"), F.greatest("x.other", "y.other").alias("dst"), (F.least("x.weight", "y.weight") * F.when(F.col("x.n") <= 5, 0.5).otherwise(0.4)).alias("weight"))
    kept = clustering.ranked_top(made.withColumn("name", F.concat_ws("|", "src", "dst")), ["hub"], "weight", most, "name").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    plain = edges.select("src", "dst", "weight").join(h.select(F.col("node").alias("src")), "src", "left_anti").join(h.select(F.col("node").alias("dst")), "dst", "left_anti")
    return plain.select("src", "dst", "weight").unionByName(kept.select("src", "dst", "weight"))
