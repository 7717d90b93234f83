"""Eigenvalues of the normalised Laplacian against numpy's, and planted clusters found."""

import numpy as np
import pyarrow as pa
import pytest

from tablescape.operators import spectral
from tablescape.session import Buckets, stage_buckets


def planted(rng, sizes, inside, across):
    label = np.repeat(np.arange(len(sizes)), sizes)
    n = len(label)
    p = np.where(label[:, None] == label[None], inside, across)
    hit = np.triu(rng.random((n, n)) < p, 1)
    return label, [(f"n{i}", f"n{j}", float(rng.integers(1, 4))) for i, j in np.argwhere(hit)]


def laplacian(edges):
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    at, w = {x: i for i, x in enumerate(names)}, np.zeros((len(names), len(names)))
    for a, b, v in edges:
        w[at[a], at[b]] = w[at[b], at[a]] = max(v, w[at[a], at[b]])
    np.fill_diagonal(w, 0)
    d = w.sum(1)
    keep = d > 0
    w, d = w[np.ix_(keep, keep)], d[keep]
    return np.eye(len(d)) - w / np.sqrt(d[:, None] * d[None]), [x for x, k in zip(names, keep) if k]


@pytest.mark.parametrize("case", ["planted", "parts", "small"])
def test_eigenpairs(spark, case):
    rng = np.random.default_rng(6)
    if case == "planted":
        _, edges = planted(rng, [60, 50, 40, 30], 0.35, 0.01)
    elif case == "parts":  # two parts without an edge between them, a pair, and nothing to tell the rest apart
        _, edges = planted(rng, [70, 70], 0.12, 0.0)
        edges += [("x", "y", 2.0), ("x", "x", 5.0), ("y", "x", 1.0), ("z", "z", 1.0), ("n1", "n3", 0.0)]
    else:
        edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    u, values = spectral.spectral_embedding(df, 6 if case != "small" else 9)
    lap, names = laplacian(edges)
    want = np.linalg.eigvalsh(lap)
    assert np.allclose(values, want[: len(values)], atol=1e-6) and len(values) == min(6 if case != "small" else 9, len(names))
    rows = {r["node"]: r["u"] for r in u.collect()}
    assert sorted(rows) == sorted(names)
    x = np.array([rows[v] for v in names])
    assert np.allclose(x.T @ x, np.eye(len(values)), atol=1e-8)
    assert np.abs(lap @ x - x * np.array(values)).max() < 1e-4


def test_planted_clusters(spark):
    rng = np.random.default_rng(2)
    label, edges = planted(rng, [40, 30, 30], 0.4, 0.02)
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = {r["node"]: r["cluster"] for r in spectral.spectral_clusters(df, 3).collect()}
    pairs = {(label[int(v[1:])], c) for v, c in got.items()}
    assert len(pairs) == 3 and len(got) == 100  # equal up to names
    assert spectral.spectral_clusters(df.where("false"), 3).count() == 0
    assert spectral.spectral_clusters(df.limit(1), 3).count() == 2


def test_many_parts(spark):
    """Nodes in many parts, edges within and across: the same eigenpairs; the blocks meet without a shuffle."""
    rng = np.random.default_rng(9)
    _, edges = planted(rng, [40, 30], 0.2, 0.02)
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    u, values = spectral.spectral_embedding(df, 3, part=9)
    lap, names = laplacian(edges)
    rows = {r["node"]: r["u"] for r in u.collect()}
    x = np.array([rows[v] for v in names])
    assert len(rows) == len(names) and np.allclose(values, np.linalg.eigvalsh(lap)[:3], atol=1e-6)
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-8) and np.abs(lap @ x - x * np.array(values)).max() < 1e-4


def test_blocks_meet_without_a_shuffle(spark):
    blocks = [stage_buckets(spark.range(8).selectExpr("cast(id as int) part", "1 n", f"array({i}d) x"), "block", "part", 4) for i in range(3)]
    df, names = spectral._beside({"b": [b.hint("merge") for b in blocks]})
    assert sorted(tuple(r) for r in df.collect()) == [(i, 1, [0.0], [1.0], [2.0]) for i in range(8)] and names == {"b": ["b_0", "b_1", "b_2"]}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_panels_are_rows_of_their_own(spark):
    """A row holds one panel, however many blocks are combined, and those of a part come together without a shuffle or a join."""
    space = Buckets(spark, "block", "part", 4)
    for i in range(9):
        space.add(spark.range(8).selectExpr("cast(id as int) part", "1 n", f"cast('{i}' as binary) x"))
    df = space.read(*range(1, 9))
    assert sorted((r["part"], r["n"], r["x"]) for r in df.collect()) == [(part, 1, str(i).encode()) for part in range(8) for i in range(1, 9)]
    together = df.groupBy("part").applyInArrow(lambda panels: pa.table({"part": panels.column("part").slice(0, 1), "pieces": pa.array([sorted(panels.column("piece").to_pylist())], pa.list_(pa.int32()))}), "part int, pieces array<int>")
    assert sorted(map(tuple, together.collect())) == [(part, [*range(1, 9)]) for part in range(8)]
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    space.close()
