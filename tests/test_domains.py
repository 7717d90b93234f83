"""Distances, adaptive density clustering, domain naming and scorecards on a small catalog of three areas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablescape.operators import cascade, clustering, distances, domains, gap, similarity, validation


@pytest.fixture(scope="module")
def catalog(spark):
    areas = {"customer": ["account", "profile", "address"], "order": ["orderitem", "orderstatus", "shipment"], "log": ["logentry", "logsource"]}
    cols, edges = [], []
    for hub, rest in areas.items():
        cols += [(hub, 1, "id", "int", "integer", True, False, True, False), (hub, 2, "name", "text", "string", False, False, False, True)]
        for t in rest:
            cols += [(t, 1, "id", "int", "integer", True, False, True, False), (t, 2, f"{hub}_id", "int", "integer", False, True, False, False), (t, 3, "note", "text", "string", False, False, False, True)]
            edges.append((t, hub, 0.9))
    edges.append(("order", "customer", 0.4))
    c = spark.createDataFrame(cols, "table_name string, ordinal int, column_name string, column_type string, type_class string, is_pk boolean, is_fk boolean, is_unique boolean, is_nullable boolean")
    return c, spark.createDataFrame(edges, "src string, dst string, weight double")


def test_distances(catalog):
    c, e = catalog
    d = {(r["a"], r["b"]): r["distance"] for r in distances.composite_distance(c, e).collect()}
    assert len(d) == 55 and all(0 <= x <= 1 for x in d.values())
    assert d["account", "customer"] < d["account", "address"] < d["account", "log"] == 1.0
    g = {(r["a"], r["b"]): r["distance"] for r in distances.diagram_distance(c, e).collect()}
    assert len(g) == 55 and g["account", "customer"] < g["account", "logentry"]
    nodes = c.select(F.col("table_name").alias("node")).distinct()
    got = distances.adaptive_dbscan(distances.composite_distance(c, e), e, nodes).collect()
    assert len(got) == 11 and any(r["role"] == "core" for r in got)
    assert cascade.refined(distances.composite_distance(c, e), e, nodes)[0].count() == 11
    assert distances.least_points("micro", 60, 8.0, 1.0) == 5 and distances.resolution(300, 0.001) == "macro"


def test_components_are_merged_and_hubs_removed(spark, catalog):
    c, e = catalog
    m = distances.merge_small_components(c, e).collect()
    # the two tables of logs and their hub are one component, joined to the largest by its most like pair
    made = [r for r in m if r["src"].startswith("log") and not r["dst"].startswith("log")]
    assert len(m) == e.count() + 1 and len(made) == 1 and made[0]["weight"] == pytest.approx(0.4 * 1.0)
    h = spark.createDataFrame([("customer",), ("order",), ("log",)], "node string")
    pairs = {(r["src"], r["dst"]) for r in distances.without_hubs(e, h).collect()}
    assert ("account", "address") in pairs and not any("customer" in p for p in pairs)


def test_domains(spark, catalog):
    c, e = catalog
    h = spark.createDataFrame([("customer",), ("order",), ("log",)], "node string")
    m = clustering.hub_seeded(e, h).select("node", "cluster")
    assert {r["node"]: r["cluster"] for r in m.collect()}["shipment"] == "order"
    d = clustering.structural_domains(m, e, h)
    assert {r["cluster"]: (r["core"], r["hubs"]) for r in d.collect()}["log"] == (["logentry", "logsource"], ["log"])
    names = {r["cluster"]: r["name"] for r in domains.domain_names(d, domains.dominant_term(m)).collect()}
    assert names == {"customer": "Customer Domain", "order": "Order Domain", "log": "Logging & Monitoring Domain"}
    assert {r["cluster"]: r["term"] for r in domains.dominant_term(m).collect()}["log"] == "Logging & Monitoring"
    assert {r["cluster"]: r["hub"] for r in domains.dominant_hub(m, h).collect()}["order"] == "order"
    s = domains.cluster_scores(validation.community_report(e, m), domains.business_coherence(m)).collect()
    assert all(0 <= r["score"] <= 1 for r in s)
    assert domains.business_constraints(e, m, m.select("node")).first()["cyclic"] == 0
    assert 0 < domains.semantic_validity(e, m, c).first()["score"] <= 1
    small = clustering.consolidate(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "node string, cluster string"), spark.createDataFrame([("d", "a", 1.0)], "src string, dst string, weight double"))
    assert {r["cluster"] for r in small.collect()} == {"x"}
    sims = spark.createDataFrame([("customer", "order", 0.9)], "a string, b string, similarity double")
    two = e.unionByName(spark.createDataFrame([("customer", "order", 0.3)], "src string, dst string, weight double"))
    assert {r["cluster"] for r in clustering.hub_consolidation(two, h, sims).collect()} == {"customer", "log"}
    assert clustering.hub_affinity(e, h, spark.createDataFrame([("account", "k"), ("profile", "k")], "node string, cluster string")).where("hub = 'customer'").first()["cluster"] == "k"


def test_catalog_lookups(spark, catalog):
    c, e = catalog
    rels = e.select(F.col("src").alias("source_table"), F.concat("dst", F.lit("_id")).alias("source_column"), F.col("dst").alias("target_table"), F.lit("id").alias("target_column"))
    assert {(r["source_table"], r["target_table"]) for r in domains.infer_keys(c).collect()} == {(r["src"], r["dst"]) for r in e.collect() if r["weight"] == 0.9}
    long = spark.createDataFrame([("order", "id"), ("orders", "id"), ("line", "order_id"), ("line", "orders_id")], "table_name string, column_name string")
    assert {(r["source_column"], r["target_table"]) for r in domains.infer_keys(long).collect()} == {("order_id", "orders"), ("orders_id", "orders")}
    cols = [("line", 1, "customerid_fk", True), ("line", 2, "CustomerId", False), ("line", 3, "theOrder", True), ("line", 4, "order2", True), ("line", 5, "item", False)]
    cols = spark.createDataFrame(cols, "table_name string, ordinal int, column_name string, is_fk boolean")
    links = spark.createDataFrame([("line", t) for t in ("Customer", "Order", "item", "x", "x", None)] + [("none", "Order")], "source_table string, target_table string")
    assert {tuple(r) for r in domains.key_columns(links, cols).collect()} == {("line", "Customer", "CustomerId"), ("line", "Order", "theOrder"), ("line", "item", ""), ("line", "x", ""), ("line", None, ""), ("none", "Order", "")}
    st = {r["table_name"]: r for r in domains.table_statistics(c, rels).collect()}
    assert st["customer"]["n_rels"] == 4 and st["customer"]["size"] == "small"
    assert "account" in domains.table_text(c, rels).where("table_name = 'account'").first()["text"]
    assert domains.table_text(c, rels, 20).first()["text"].endswith("...")
    assert not domains.junction_flag(c).where("is_junction").count()
    assert {r["cluster"] for r in domains.foreign_key_buckets(c).collect()} == {"entities", "mixed"}
    of = spark.createDataFrame([("t", "x", 0.2), ("t", "y", 0.9), ("u", None, 0.1)], "table_name string, domain string, confidence double")
    assert {r["table_name"]: (r["primary"], r["domains"]) for r in domains.domains_of(of).collect()} == {"t": ("y", ["x", "y"]), "u": ("overview", ["overview"])}
    codes = spark.createDataFrame([("T", "f", "s", [("A", "Active")]), ("U", "g", "s", [("B", "Blocked")])], "table_name string, field_name string, sheet_name string, code_values array<struct<code: string, description: string>>")
    assert domains.codes_for(codes, words="activ").count() == 1 and domains.codes_for(codes, "t", "F").count() == 1 and domains.codes_for(codes, "u").count() == 1
    files = spark.createDataFrame([("p", 1, "{}"), ("p", 2, '{"tables": [{"name": "a"}, {"name": "b"}], "relationships": []}')], "project_id string, updated_at int, data string")
    assert tuple(domains.project_sizes(files).first()) == ("p", 2, 0)
    assert (domains.path_for(19), domains.path_for(50), domains.path_for(51), domains.live_algorithm(100, 0.2), domains.algorithm_for(50, 0.2, 0.05), domains.fallback_for(3, 0.5, 0.1, 3, 0)) == ("simple", "medium", "full", "dependency", "spectral", "components")
    one = spark.range(1).select(domains.overall_quality(*map(F.lit, (1.0, 0.0, 1e9, 1.0, 1.0, 1.0))).alias("q"), domains.verdict(*map(F.lit, (1.0, 1.0, 1.0, 1.0)), F.lit(False)).alias("v")).first()
    assert one["q"] == pytest.approx(1) and one["v"]["valid"]


def test_exact_validation_in_tiles(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 1.0, 2.5]) + (i % 3), rng.random() * (i % 4)], [0, 1, 2, None][i % 4]) for i in range(60)] + [(90, [9.0, 9.0], 7), (91, None, 1), (92, [1.0, None], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").withColumn("cluster", F.lit("x"))
    p = validation.distance_profiles(df, "id", "label", "v", tile=16)
    pts = [r for r in rows if r[0] < 91]
    want, least, most = {}, math.inf, 0
    for i, x, c in pts:
        by = {}
        for j, y, o in pts:
            if i != j:
                by.setdefault(o, []).append(math.dist(x, y))
                least, most = (least, max(most, math.dist(x, y))) if c == o else (min(least, math.dist(x, y)), most)
        if c in by:
            a, b = sum(by[c]) / len(by[c]), min(sum(v) / len(v) for o, v in by.items() if o != c)
            want[i] = (b - a) / max(a, b)
    got = {r["id"]: r["silhouette"] for r in validation.silhouette_exact(p).collect()}
    assert got == pytest.approx(want) and 90 not in got
    assert validation.dunn_exact(p).first()["dunn"] == pytest.approx(least / most)
    none = validation.distance_profiles(df.where("false"), "id", "label", "v")
    assert validation.silhouette_exact(none).count() == 0 and validation.dunn_exact(none).first()["dunn"] == 0


def test_vector_clustering(spark):
    rows = [(i, [float(i % 3) * 5 + (i * 7 % 5) * 0.1, float(i % 3)], i % 3) for i in range(45)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    for f in (clustering.k_means, clustering.bisecting):
        got = f(df, "id", "v", 3).join(df.select(F.col("id").alias("node"), "label"), "node")
        assert validation.agreement(got, "cluster", "label").first()["ari"] == pytest.approx(1)
    gaps = {r["k"]: r["gap"] for r in gap.gap_curve(df, "id", "v", [1, 2, 3]).collect()}
    assert gaps[3] > gaps[1]
    s = [r["silhouette"] for r in validation.silhouette(df, "id", "label", "v").collect()]
    assert min(s) > 0.9
    near = similarity.similar_pairs(df.where("id < 6"), "id", "v", -1.0, tile=2).count()
    assert near == 10  # the vector (0, 0) has no direction; five others make ten pairs


def test_distance_profiles_of_many_clusters(spark, monkeypatch):
    """A task gives one row a point and cluster, in parts where more clusters than it may keep are met; blocks are not joined."""
    rng = random.Random(8)
    rows = [(i, [rng.random(), rng.random() * (i % 3)], f"c{i % 9}" if i % 10 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label string").repartition(4)
    want = {}
    for i, x, c in df.collect():
        for j, y, o in df.collect() if i < 5 else []:
            if i != j:
                want.setdefault((i, o), []).append(math.dist(x, y))
    for clusters in (256, 3):
        monkeypatch.setattr(validation, "CLUSTERS", clusters)
        p = validation.distance_profiles(df, "id", "label", "v", tile=20)
        got = {(r["id"], r["other"]): (r["total"], r["n"], r["least"], r["most"]) for r in p.collect()}
        assert len(got) == 90 * 10 and {k: got[k] for k in want} == {k: pytest.approx((sum(v), len(v), min(v), max(v))) for k, v in want.items()}
        assert "Join" not in p._jdf.queryExecution().executedPlan().toString()
