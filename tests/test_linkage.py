"""Average linkage by rounds against one merge at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescape.operators import linkage


def sequential(n, pairs, key, most, missing):
    """[(a, b, height)] of plain average linkage: the least (mean distance, key) first; pairs not in ``pairs`` are ``missing`` apart, or infinitely."""
    s, c, key = np.zeros((n, n)), np.zeros((n, n)), {p: k for p, k in key.items()}
    for (a, b), d in pairs.items():
        s[a, b] = s[b, a] = d
        c[a, b] = c[b, a] = 1
    size, alive, out = {i: 1 for i in range(n)}, set(range(n)), []
    k = np.full((n, n), 2**63 - 1, dtype=np.int64)
    for (a, b), x in key.items():
        k[a, b] = k[b, a] = x
    while True:
        ids = np.array(sorted(alive))
        full = np.array([size[i] for i in ids])
        full = full[:, None] * full[None, :]
        ss, cc = s[np.ix_(ids, ids)], c[np.ix_(ids, ids)]
        ok = (cc == full) if missing is None else (cc > 0)
        if most is not None:
            z = np.array([size[i] for i in ids])
            ok &= z[:, None] + z[None, :] <= most
        ok &= np.triu(np.ones_like(ok), 1).astype(bool)
        if not ok.any():
            return out
        mean = ss / full if missing is None else (ss + missing * (full - cc)) / full
        mean = np.where(ok, mean, np.inf)
        low = mean.min()
        at = np.argwhere(mean <= low + 1e-12)
        i, j = min(at.tolist(), key=lambda p: k[ids[p[0]], ids[p[1]]])
        a, b = int(ids[i]), int(ids[j])
        out.append((a, b, mean[i, j]))
        for m in (s, c):
            m[a] += m[b]
            m[:, a] += m[:, b]
        k[a] = np.minimum(k[a], k[b])
        k[:, a] = k[a]
        size[a] += size[b]
        alive.discard(b)


def clusters(n, merges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, *_ in merges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in range(n)}


def keys_of(spark, df):
    return {(r["a"], r["b"]): r["k"] for r in df.select("a", "b", F.xxhash64("a", "b").alias("k")).collect()}


def test_500_vectors_equal_a_dendrogram_cut(spark):
    rng = np.random.default_rng(8)
    n = 500
    x = np.concatenate([rng.normal(size=(n // 2, 6)) * 0.2 + rng.integers(0, 5, (n // 2, 1)), rng.normal(size=(n - n // 2, 6))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = {(i, j): float(d[i, j]) for i in range(n) for j in range(i + 1, n)}
    df = spark.createDataFrame([(a, b, v) for (a, b), v in pairs.items()], "a int, b int, distance double")
    merges = linkage.average_linkage(df, most=None)
    got = sorted((r["height"], r["a"], r["b"]) for r in merges.collect())
    want = sequential(n, pairs, keys_of(spark, df), None, None)
    assert len(got) == n - 1
    assert np.allclose([g[0] for g in got], sorted(w[2] for w in want), rtol=1e-9)
    for k in (1, 7, 60, 499, 500):
        cut = {r["node"]: r["cluster"] for r in linkage.cut(merges, spark.range(n).select(F.col("id").cast("int").alias("node")), k).collect()}
        assert cut == clusters(n, want[: n - k])


@pytest.mark.parametrize("most,missing", [(4, None), (None, None), (6, 3.0), (None, 3.0)])
def test_sparse_ties_and_limits(spark, most, missing):
    rng = np.random.default_rng(5)
    n = 60
    pairs = {(int(a), int(b)): float(rng.integers(1, 4)) for a, b in (sorted(rng.choice(n, 2, replace=False)) for _ in range(320))}
    df = spark.createDataFrame([(a, b, v) for (a, b), v in pairs.items()], "a int, b int, distance double").repartition(3)
    got = linkage.average_linkage(df, most=most, missing=missing).collect()
    want = sequential(n, pairs, keys_of(spark, df), most, missing)
    assert sorted(round(r["height"], 9) for r in got) == sorted(round(w[2], 9) for w in want)
    assert clusters(n, [(r["a"], r["b"]) for r in got]) == clusters(n, want)
    assert most is None or max(r["n"] for r in got) <= most


def test_forced_and_empty(spark):
    edges = spark.createDataFrame([("a", "b", 5.0), ("b", "a", 1.0), ("c", "d", 4.0), ("e", "e", 9.0), ("f", None, 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    got = {r["node"]: r["cluster"] for r in linkage.agglomerated(edges, nodes, 2).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "c", "g": "c"}
    assert linkage.agglomerated(edges, nodes, 5).select("cluster").distinct().count() == 5
    assert linkage.average_linkage(edges.where("false").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("distance"))).count() == 0
    assert linkage.agglomerated(edges.where("false"), nodes.where("false"), 3).count() == 0


def test_pairs_that_cannot_merge_go(spark, monkeypatch):
    """On a star only one pair merges; what is left of it is not written any more."""
    written, stage = [], linkage.stage

    def counted(df, label, *by):
        out = stage(df, label, *by)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(linkage, "stage", counted)
    pairs = spark.createDataFrame([(0, i, float(i)) for i in range(1, 30)], "a long, b long, distance double")
    assert [(r["a"], r["b"], r["height"]) for r in linkage.average_linkage(pairs).collect()] == [(0, 1, 1.0)]
    assert [n for label, n in written if label == "linkage"] == [29, 0]
