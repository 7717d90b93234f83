"""Each branch of refinement and cascade by a hand-made graph."""

import pytest
from pyspark.sql import functions as F

from tablescape.operators import cascade


def groups(spark, k=4, n=6, across=0.9, within=0.1):
    names = [f"g{i}n{j}" for i in range(k) for j in range(n)]
    pairs = [(a, b, within + 0.001 * i if a[:2] == b[:2] else across) for i, a in enumerate(names) for b in names if a < b]
    edges = [(a, b, 1.0) for a, b, d in pairs if a[:2] == b[:2]] + [(f"g{i}n0", f"g{i + 1}n0", 0.1) for i in range(k - 1)]
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return df(pairs, "a string, b string, distance double"), df(edges, "src string, dst string, weight double"), df([(x,) for x in names], "node string")


def sets(membership):
    found = {}
    for r in membership.collect():
        if r["cluster"] is not None:
            found.setdefault(r["cluster"], set()).add(r["node"])
    return sorted(map(sorted, found.values()))


def test_silhouette_by_hand(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 4.0), ("b", "c", 5.0), ("a", "d", 8.0), ("b", "d", 8.0), ("c", "d", 2.0), ("a", "x", 3.0), ("b", "x", 3.0), ("c", "x", 9.0), ("d", "x", 9.0)], "a string, b string, distance double")
    m = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("x", None)], "node string, cluster int")
    # a: own 1, least other is noise at 3; b the same; c: own 2, other 4.5; d: own 2, other 8
    want = ((3 - 1) / 3 + (3 - 1) / 3 + (4.5 - 2) / 4.5 + (8 - 2) / 8) / 4
    assert cascade.pair_silhouette(pairs, m) == pytest.approx(want)
    assert cascade.pair_silhouette(pairs, m.where("node = 'a'")) == 0.0


def test_refinement(spark):
    pairs, edges, nodes = groups(spark)
    best, found = cascade.refined(pairs, edges, nodes, "macro")
    assert found["tried"] == 1 and found["level"] == "macro" and found["modularity"] > 0.3 and found["silhouette"] > 0.2
    assert sets(best.select("node", "cluster")) == [[f"g{i}n{j}" for j in range(6)] for i in range(4)]
    best, found = cascade.refined(pairs, edges, nodes, "meso")  # its reach takes all groups together
    assert found["tried"] == 3 and found["level"] == "macro" and len(sets(best.select("node", "cluster"))) == 4


def test_cascade_branches(spark):
    pairs, edges, nodes = groups(spark)
    good = nodes.select("node", F.substring("node", 1, 2).alias("cluster"))
    poor = nodes.select("node", F.lit(None).cast("string").alias("cluster"))
    names = lambda tried: [t["step"] for t in tried]
    best, tried = cascade.cascade(pairs, edges, nodes, steps={"multi_resolution": lambda: good})
    assert names(tried) == ["multi_resolution"] and tried[0]["valid"] and len(sets(best)) == 4
    best, tried = cascade.cascade(pairs, edges, nodes, steps={"multi_resolution": lambda: poor})
    assert names(tried) == ["multi_resolution", "adaptive"] and len(sets(best)) == 4
    best, tried = cascade.cascade(pairs, edges, nodes, steps={"multi_resolution": lambda: poor, "adaptive": lambda: poor})
    assert names(tried) == ["multi_resolution", "adaptive", "fallback"] and len(sets(best)) >= 1

    def broken():
        raise ValueError("no distances")

    best, tried = cascade.cascade(pairs, edges, nodes, steps={"multi_resolution": broken})
    assert names(tried) == ["error", "predicted"] and tried[0]["why"] == "ValueError: no distances" and best.columns == ["node", "cluster"]
    # a later run that is worse does not replace an earlier one
    scores = iter([(False, 0.5), (False, 0.4), (False, 0.1)])
    best, tried = cascade.cascade(pairs, edges, nodes, validate=lambda m: next(scores), steps={"multi_resolution": lambda: good, "adaptive": lambda: poor, "fallback": lambda: poor})
    assert len(tried) == 3 and len(sets(best)) == 4


def test_fallbacks(spark):
    pairs, edges, nodes = groups(spark)
    cut = edges.where("weight > 0.5")
    more = nodes.unionByName(spark.createDataFrame([("lone",)], "node string"))
    assert len(sets(cascade.fallback("components", cut, more))) == 5
    assert len(sets(cascade.fallback("components_with_singletons", cut, more))) == 4
    assert len(sets(cascade.fallback("bottom_up", edges, nodes, 4))) == 4
    assert len(sets(cascade.fallback("constraints", edges, nodes))) == 4
    assert sum(map(len, sets(cascade.fallback("split", edges, nodes)))) == 24
    assert len(sets(cascade.fallback("features", edges, nodes, 2))) == 2
    with pytest.raises(ValueError):
        cascade.fallback("none", edges, nodes)
    shape = cascade.graph_shape(cut, more)
    assert shape["components"] == 5 and shape["largest_share"] == pytest.approx(6 / 25)
    shared = cascade.resolutions(pairs, edges, nodes)
    assert shared.count() == 24 and set(shared.columns) == {"node", "cluster"}


def test_runs_are_made_once(spark, monkeypatch):
    pairs, edges, nodes = groups(spark)
    made, run = [], cascade.distances.adaptive_dbscan
    monkeypatch.setattr(cascade.distances, "adaptive_dbscan", lambda p, e, n, level: made.append(level) or run(p, e, n, level))
    cascade.cascade(pairs, edges, nodes, validate=lambda m: (False, 0.0))
    assert sorted(made) == ["macro", "meso", "micro"]


def test_a_partition_gives_a_forest(spark):
    from tablescape.operators.components import connected_components, spanning

    links = spark.range(300).selectExpr("id AS a").crossJoin(spark.range(300).selectExpr("id AS b")).where("a < b AND a % 3 = b % 3").withColumn("whole", F.lit(False)).repartition(2)
    extra = spark.createDataFrame([(1, 900, True), (2, 900, True)], "a long, b long, whole boolean")
    got = spanning(links.unionByName(extra).coalesce(2))
    assert got.where("NOT whole").count() <= 2 * 297 and got.where("whole").count() == 2
    comps = connected_components(got.where("NOT whole"), "a", "b")
    assert {tuple(r) for r in comps.collect()} == {(i, i % 3) for i in range(300)}
    names = links.selectExpr("'n' || a AS a", "'n' || b AS b", "whole")
    comps = connected_components(spanning(names), "a", "b")
    assert comps.count() == 300 and comps.select("component").distinct().count() == 3
