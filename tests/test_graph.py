"""Graph operators against hand-computed answers for the catalog of the given tables, and against brute force on random graphs."""

import itertools
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tablescape.operators import clustering, graph, hubs, validation
from tablescape.sources.catalog import FOREIGN_KEYS, TABLES

# Fixed values: (in, out, betweenness, standard rank, compat rank) of the catalog graph.
EXPECTED = {
    "region": (1, 0, 0.0, 0.186861, 0.017400), "nation": (2, 1, 0.076923, 0.168566, 0.023595), "customer": (1, 1, 0.025641, 0.091117, 0.016558), "supplier": (1, 1, 0.051282, 0.055927, 0.013750),
    "part": (1, 0, 0.0, 0.055927, 0.013750), "orders": (1, 1, 0.025641, 0.055927, 0.013750), "lineitem": (0, 3, 0.076923, 0.043579, 0.010714), "documents": (1, 0, 0.0, 0.080622, 0.019821), "labels": (0, 1, 0.0, 0.043579, 0.010714),
}


@pytest.fixture(scope="module")
def star(spark):
    edges = spark.createDataFrame([(s, t) for s, _, t, _ in FOREIGN_KEYS], "src string, dst string")
    nodes = spark.createDataFrame([(t,) for t in TABLES], "node string")
    return edges, nodes


def test_catalog_graph(star):
    edges, nodes = star
    d = {r["node"]: r for r in graph.degrees(edges, nodes).collect()}
    b = {r["node"]: r["betweenness"] for r in graph.betweenness(edges, nodes).collect()}
    p = {r["node"]: r["rank"] for r in graph.pagerank(edges, nodes).collect()}
    q = {r["node"]: r["rank"] for r in graph.pagerank(edges, nodes, compat=True).collect()}
    for n in TABLES:
        i, o, w, std, compat = EXPECTED.get(n, (0, 0, 0.0, 0.043579, 0.010714))
        assert (d[n]["in_degree"], d[n]["out_degree"]) == (i, o)
        assert b[n] == pytest.approx(w, abs=1e-6) and p[n] == pytest.approx(std, abs=2e-6) and q[n] == pytest.approx(compat, abs=2e-6)
    assert sum(p.values()) == pytest.approx(1) and sum(q.values()) == pytest.approx(0.193624, abs=1e-5)
    comps = nodes.join(graph.connected_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("c")).groupBy("c").count().collect()
    assert sorted(r["count"] for r in comps) == [1, 1, 1, 1, 1, 2, 7]
    assert all(r["coefficient"] == 0 for r in graph.clustering_coefficient(edges, nodes).collect())
    assert [r["node"] for r in graph.shortest_path(edges, "lineitem", "region").orderBy("position").collect()] == ["lineitem", "supplier", "nation", "region"]
    assert graph.shortest_path(edges, "lineitem", "labels").count() == 0
    h = {r["node"]: r["confidence"] for r in hubs.hub_scores(edges, nodes).collect() if r["is_hub"]}
    assert h == {"nation": 1.0, "lineitem": 0.8}


def random_graph(seed, n=14, e=24):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(e)]


def reach(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    pairs = random_graph(seed)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    near, nodes = reach(pairs), sorted({x for p in pairs for x in p})
    dist, count = {}, {}
    for s in nodes:
        dist[s], count[s], q = {s: 0}, {s: 1}, deque([s])
        while q:
            x = q.popleft()
            for y in near[x]:
                if y not in dist[s]:
                    dist[s][y], count[s][y] = dist[s][x] + 1, 0
                    q.append(y)
                if dist[s][y] == dist[s][x] + 1:
                    count[s][y] += count[s][x]
    got = {(r["source"], r["node"]): r["hops"] for r in graph.bfs(edges, graph.nodes_of(edges).select(F.col("node").alias("source"))).collect()}
    assert got == {(s, n): d for s in nodes for n, d in dist[s].items()}
    n = len(nodes)
    want = {v: sum(count[s][v] * count[v][t] / count[s][t] for s in nodes for t in nodes if s != v != t != s and t in dist[s] and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]) / ((n - 1) * (n - 2)) for v in nodes}
    assert {r["node"]: pytest.approx(r["betweenness"]) for r in graph.betweenness(edges).collect()} == want
    comp = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert comp == {v: min(dist[v]) for v in nodes}
    tri = {v: sum(b in near[a] for a, b in itertools.combinations(sorted(near[v]), 2)) for v in nodes}
    cc = {r["node"]: r for r in graph.clustering_coefficient(edges).collect()}
    for v in nodes:
        k = len(near[v])
        assert cc[v]["triangles"] == tri[v] and cc[v]["coefficient"] == pytest.approx(tri[v] / (k * (k - 1) / 2) if k > 1 else 0)
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)

    def shortest_cycle(v):
        seen, front, length = set(), {v}, 0
        while front:
            length += 1
            front = {y for x in front for y in out[x]} - seen
            if v in front:
                return length
            seen |= front
        return None

    assert {r["node"]: r["length"] for r in graph.cycles(edges).collect()} == {v: c for v in nodes if (c := shortest_cycle(v))}


def test_long_chain_and_parallel_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3)], "src long, dst long")
    comp = {r["node"]: r["component"] for r in graph.connected_components(chain).collect()}
    assert comp == {**{i: 0 for i in range(201)}, 500: 500}
    twice = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "a")], "src string, dst string")
    d = {r["node"]: (r["degree"], r["n_neighbours"]) for r in graph.degrees(twice).collect()}
    assert d == {"a": (3, 2), "b": (2, 1), "c": (1, 1)}
    assert graph.connected_components(chain.where("false")).count() == 0


def test_row_order_does_not_matter(spark):
    pairs = [(f"n{a}", f"n{b}", 1.0 + (a * b) % 3) for a, b in random_graph(5) if a != b]
    one, two = spark.createDataFrame(pairs, "src string, dst string, weight double"), spark.createDataFrame(pairs[::-1], "src string, dst string, weight double").repartition(3)
    h = spark.createDataFrame([("n1",), ("n2",)], "node string")
    for f in (lambda e: clustering.hub_seeded(e, h), clustering.label_propagation, lambda e: graph.dependency_centrality(e).withColumn("centrality", F.round("centrality", 9))):
        assert sorted(map(str, f(one).collect())) == sorted(map(str, f(two).collect()))


def test_dbscan_against_plain(spark):
    rng = random.Random(2)
    pts = {i: (rng.random() * 4, rng.random() * 4) for i in range(60)}
    close = [(a, b) for a, b in itertools.combinations(pts, 2) if (pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2 <= 0.16]
    near = reach(close)
    core = {i for i in pts if len(near[i]) >= 3}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += [y for y in near[x] if y in core]
    want = {i: label[i] if i in core else min((label[y] for y in near[i] if y in core), default=None) for i in pts}
    got = clustering.dbscan(spark.createDataFrame(close, "a long, b long"), spark.createDataFrame([(i,) for i in pts], "node long"), 3)
    assert {r["node"]: r["cluster"] for r in got.collect()} == want


def test_agreement_and_modularity(spark):
    m = spark.createDataFrame([(i, i % 3, i % 3, i // 10) for i in range(30)], "node long, a long, b long, c long")
    same = validation.agreement(m, "a", "b").first()
    assert same["ari"] == pytest.approx(1) and same["nmi"] == pytest.approx(1)
    assert validation.agreement(m, "a", "c").first()["ari"] < 0.1
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 3, 1.0), (0, 3, 1.0)], "src long, dst long, weight double")
    one = spark.createDataFrame([(i, 0) for i in range(6)], "node long, cluster long")
    two = spark.createDataFrame([(i, i // 3) for i in range(6)], "node long, cluster long")
    assert validation.modularity(e, one).first()[0] == pytest.approx(0)
    assert validation.modularity(e, two).first()[0] == pytest.approx(6 / 7 - 0.5)
    assert validation.graph_quality(e, two).first()["coverage"] == pytest.approx(6 / 7)
    r = {x["cluster"]: x for x in validation.community_report(e, two).collect()}
    assert r[0]["internal"] == 3 and r[0]["external"] == 1 and r[0]["conductance"] == pytest.approx(1 / 7)


def test_degrees_hold_a_pair_once(spark):
    """Both directions of a pair are one row before its ends are; null ends count as they did."""
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 1), (3, 3), (None, 2), (4, None), (1, 5)], "src long, dst long")
    found = graph.degrees(edges)
    got = {r["node"]: tuple(r)[1:] for r in found.collect()}
    assert got == {1: (2, 2, 4, 2), 2: (2, 2, 4, 1), 3: (1, 1, 2, 0), 4: (0, 1, 1, 0), 5: (1, 0, 1, 1), None: (1, 1, 2, 0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.rindex("HashAggregate")


def test_pagerank_sends_lists(spark, monkeypatch):
    """A source and its share go once a list of successors, of which a node of many edges has several."""
    monkeypatch.setattr(graph, "LISTED", 8)
    pairs = [(0, i) for i in range(1, 101)] + [(i, (i * 7) % 100 + 1) for i in range(1, 90)] + [(i, 0) for i in range(5, 50)] + [(0, 3)] * 4
    edges = spark.createDataFrame(pairs, "src long, dst long")
    rows = graph._listed(edges.groupBy("src", "dst").agg(F.count("*").alias("m")), edges.groupBy("src").agg(F.count("*").alias("share"))).collect()
    assert sum(len(r["to"]) for r in rows) == len(set(pairs)) and 10 < sum(r["src"] == 0 for r in rows) <= 14 and sum(r["src"] == 7 for r in rows) <= 2
    rank = {i: 1 / 101 for i in range(101)}
    for _ in range(10):
        new, out = dict.fromkeys(rank, 0.15 / 101), {}
        for s, _t in pairs:
            out[s] = out.get(s, 0) + 1
        for s, t in pairs:
            new[t] += 0.85 * rank[s] / out[s]
        loose = sum(r for n, r in rank.items() if n not in out)
        rank = {n: r + 0.85 * loose / 101 for n, r in new.items()}
    assert {r["node"]: r["rank"] for r in graph.pagerank(edges, rounds=10, tolerance=0.0).collect()} == pytest.approx(rank)
