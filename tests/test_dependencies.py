"""Dependency hubs, their domains and the limits of traversals, by hand."""

import pytest

from tablescape.operators import clustering, graph, hubs
from tablescape.sources import catalog


def test_domain_of_a_hub(spark):
    e = spark.createDataFrame([("order1", "customer"), ("order2", "customer"), ("customer", "customer_profile"), ("customer", "status_type"), ("customer", "customer")], "src string, dst string")
    n = hubs.dependency_hubs(e.where("src <> dst"))
    assert {r["node"]: r["node_type"] for r in n.collect()} == {"order1": "entity", "order2": "entity", "customer": "hub", "customer_profile": "entity", "status_type": "reference"}
    (d,) = clustering.dependency_domains(e, n).collect()
    assert (d["cluster"], d["core"], d["supporting"], d["lookup"], d["n"], d["n_consumers"]) == ("customer", ["customer_profile"], [], ["status_type"], 3, 2)
    assert d["cohesion"] == pytest.approx(2 / 3) and d["coupling"] == pytest.approx(1 / 3) and d["score"] == pytest.approx(2 / 3)
    assert clustering.dependency_domains(e, n, most=2).count() == 0


def test_traversals_raise_at_their_limit(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(5)], "src int, dst int")
    assert graph.bfs(e, spark.createDataFrame([(0,)], "source int"), most=6).count() == 6
    with pytest.raises(ValueError):
        graph.bfs(e, spark.createDataFrame([(0,)], "source int"), most=3)


def test_links_of_orders(spark, tmp_path):
    """The links are those of the whole catalog, with null keys, orders without lines, repeated lines and ties of line numbers."""
    rows = [(k, n, (k * 7 + n * 5) % 12, (k + n * 3) % 23, float(n), 1.0) for k in range(1, 40) if k % 9 for n in range(1, 6)]
    rows += [(k, 1, 3, 4, 1.0, 1.0) for k in (2, 2, 5)] + [(None, 2, 3, 4, 1.0, 1.0), (7, 1, None, 4, 1.0, 1.0), (8, 2, 6, None, 1.0, 1.0), (11, None, 9, 2, 1.0, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, k % 4 if k % 5 else None) for k in range(1, 45)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    rels = catalog.order_catalog(spark, str(tmp_path))[1].where("source_table <> target_table").select("source_table", "target_table")
    found = sorted(map(tuple, catalog.order_links(spark, str(tmp_path)).collect()))
    assert found == sorted(map(tuple, rels.collect())) and len(found) > 20


def test_joins_pass_no_table_through_the_driver(spark, tmp_path, monkeypatch):
    """Tables of one row a node or edge are not broadcast, however small their files."""
    rows = [(k, n, (k * 7 + n * 5) % 12, (k + n * 3) % 23, float(n), 1.0) for k in range(1, 40) for n in range(1, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, k % 4) for k in range(1, 40)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    plans, write = [], catalog.stage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def stage(df, label, *by):
        plans.append((label, plan(df)))
        return write(df, label, *by)

    for module in (catalog, graph, clustering):
        monkeypatch.setattr(module, "stage", stage)
    e = stage(catalog.order_links(spark, str(tmp_path)), "links")
    n = hubs.dependency_hubs(e, rounds=2, tolerance=0.0)
    plans += [("hubs", plan(n)), ("domains", plan(clustering.dependency_domains(e, n)))]
    assert [label for label, p in plans if "Broadcast" in p] == [] and len(plans) > 8
