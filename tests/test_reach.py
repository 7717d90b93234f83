"""Neighbour distances, their knee, the predicted reach and the search around it; greedy groups against the sequential rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescape.operators import reach, similarity


@pytest.mark.parametrize("tile", [16, 2048])
def test_neighbour_distances(spark, tile, monkeypatch):
    monkeypatch.setattr(reach, "FAN_IN", 3)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(150, 3)), np.ones((30, 3))])  # a group of copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [0.0] * 3), (500, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for k in (1, 5):
        got = {r["node"]: r["distance"] for r in reach.neighbour_distances(df, "id", "v", k, tile).collect()}
        assert sorted(got) == list(range(180)) and np.allclose([got[i] for i in range(180)], np.sort(d, 1)[:, k - 1])
    assert reach.neighbour_distances(df.where("id < 3"), "id", "v", 3, tile).count() == 0
    assert reach.neighbour_distances(df.where("false"), "id", "v", 3, tile).count() == 0


def test_knee(spark):
    values = [0.1 * (1 + i / 900) for i in range(900)] + [0.2 + 0.05 * i for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "distance double")
    at = reach.knee(df).first()
    s = np.sort(values)
    below = np.arange(1000) / 999 - (s - s[0]) / (s[-1] - s[0])
    assert abs(at["rank"] - below.argmax()) <= 4 and at["value"] == pytest.approx(s[at["rank"]])
    assert reach.knee(df.where("false")).count() == 0 and reach.knee(df.limit(1)).first()["rank"] == 0


def test_prediction_and_search(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(8, 2)) * 0.05 + c for c in [(i % 4, i // 4) for i in range(12)]] + [rng.random((4, 2)) * 4 + 5])
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "a int, b int, distance double")
    nodes = spark.range(n).select(F.col("id").cast("int").alias("node"))
    flat = np.sort(d[d > 0])
    assert reach.predicted(pairs, n) == (pytest.approx(max(0.1, min(1.0, flat[int(len(flat) * 0.15)]))), 4)
    assert reach.predicted(pairs.where("false"), n) == (0.5, 3)
    assert len(reach.candidates(0.5, 4)) == 6 and (0.5, 4) not in reach.candidates(0.5, 4) and reach.candidates(0.5, 4)[0][1] == 4
    best, found = reach.searched(pairs, nodes)
    assert found["tried"] > 1 and found["score"] == pytest.approx(reach.score(best))
    # the search keeps the best of all that it tried
    runs = [(reach.predicted(pairs, n)), *reach.candidates(*reach.predicted(pairs, n))]
    from tablescape.operators import clustering

    scores = [reach.score(clustering.dbscan(pairs.where(F.col("distance") <= e), nodes, p)) for e, p in runs[: found["tried"]]]
    assert found["score"] == pytest.approx(max(scores))
    sizes = spark.createDataFrame([(i, i % 12 if i < 96 else None) for i in range(100)], "node int, cluster int")
    assert reach.score(sizes) == pytest.approx(0.4 + 0.2 + 0.2 * 0.96 + 0.2)
    assert reach.score(sizes.withColumn("cluster", F.lit(None).cast("int"))) == 0.0


def greedy(n, pairs):
    near, leader = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i in sorted(n):
        if i not in leader:
            leader[i] = i
            for j in sorted(near.get(i, ())):
                leader.setdefault(j, i)
    return leader


@pytest.mark.parametrize("seed,edges", [(1, 300), (2, 1200), (3, 6000)])
def test_greedy_groups_equal_the_sequential_rule(spark, seed, edges):
    rng = np.random.default_rng(seed)
    names = [f"t{i:03d}" for i in range(500)]
    pairs = [(names[a], names[b]) for a, b in rng.integers(0, 500, (edges, 2))]
    df = spark.createDataFrame([*pairs, (None, "t001"), ("t002", "t002"), ("t003", "unknown")], "a string, b string").repartition(3)
    nodes = spark.createDataFrame([(x,) for x in names], "node string")
    want = greedy(names, [p for p in pairs if p[0] != p[1]])
    got = {r["node"]: r["leader"] for r in similarity.greedy_groups(df, nodes, least=1).collect()}
    assert got == want
    several = {v for v in want.values() if sum(w == v for w in want.values()) >= 2} if edges == 300 else None
    if several is not None:
        assert {r["leader"] for r in similarity.greedy_groups(df, nodes).collect()} == several
    assert similarity.greedy_groups(df.where("false"), nodes).count() == 0


def test_neighbours_of_many_blocks_in_few_rows(spark):
    """Each point goes once to each block, with nothing that grows with pairs of blocks; copies and non-finite vectors included."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 8)), np.ones((100, 8)), np.ones((40, 8)) * (1 + 1e-9)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [float("nan")] * 8), (901, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    found = reach.neighbour_distances(df, "id", "v", 3, 60)
    got = {r["node"]: r["distance"] for r in found.collect()}
    assert sorted(got) == list(range(540)) and np.allclose([got[i] for i in range(540)], np.sort(d, 1)[:, 2], rtol=1e-12, atol=0)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tile", [30, 40, 70, 400])
def test_similar_pairs_in_blocks(spark, tile):
    """Every pair once for odd and even numbers of blocks; no row holds a block, so no join of blocks."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(170, 5)), np.ones((30, 5)), np.zeros((1, 5))])
    rows = [(i * 3 - 100, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [1.0, None, 1.0, 1.0, 1.0]), (901, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    u = x[:200] / np.linalg.norm(x[:200], axis=1)[:, None]
    s = u @ u.T
    want = {(i * 3 - 100, j * 3 - 100): s[i, j] for i in range(200) for j in range(i + 1, 200) if s[i, j] >= 0.3}
    found = similarity.similar_pairs(df, "id", "v", 0.3, tile=tile)
    got = [((r["a"], r["b"]), r["similarity"]) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
