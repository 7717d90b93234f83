"""Graph search against brute force: results are exact where the walk sees all, and recall is measured where it does not."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescape.llm import ann


def brute(rows, k=20):
    ok = [(i, x) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    out = set()
    for qi, q in set((i, tuple(x)) for i, x in ok if i % 20 == 0):
        scored = []
        for ci, c in ok:
            if ci != qi and len(c) == len(q):
                s = 0.0
                for a, b in zip(q, c):
                    s += a * b
                scored.append((-s, ci))
        out |= {(qi, q, r + 1, ci, -s) for r, (s, ci) in enumerate(sorted(scored)[:k])}
    return {x[:1] + x[2:] for x in out}


def found(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


def test_small_shards_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_TILE", 3)
    monkeypatch.setattr(ann, "FAN_IN", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=5).round(1)]) for i in range(-20, 200)]
    at = lambda i: i + 20
    rows[at(40)], rows[at(41)], rows[at(42)], rows[at(43)] = (40, None), (41, [1.0, None, 0.0, 0.0, 0.0]), (42, [1.0, float("nan"), 0.0, 0.0, 0.0]), (43, [1.0, float("inf"), 0.0, 0.0, 0.0])
    rows[at(44)], rows[at(60)], rows[at(61)], rows[at(80)] = (44, [0.0, -0.0, 0.0, 0.0, 0.0]), (60, [1.0, 2.0]), (61, [-1.0, 2.0]), (80, [])
    for i in range(90, 150):  # a group of copies: ties go to the smaller id
        rows[at(i)] = (i, [0.5] * 5)
    rows += [(None, [1.0] * 5), rows[at(7)], rows[at(7)], rows[at(20)], rows[at(100)], *[rows[at(120)]] * 30]
    df = spark.createDataFrame([(i, x, "clash", 0) for i, x in rows], "vec_id bigint, embedding array<float>, rank string, score int")
    for shard in (11, 10_000):
        index = ann.graph_index(df, shard=shard)
        assert found(ann.nearest(index, df.where("vec_id % 20 = 0"), width=400)) == brute(rows)
    assert found(ann.op12_nearest(df)) == brute(rows)
    assert ann.op12_nearest(df.where("false")).count() == 0
    assert ann.op12_nearest(df.where("vec_id = 0")).count() == 0
    assert index.select(F.explode("ids")).distinct().count() == len({i for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)})


@pytest.mark.parametrize("kind", ["sphere", "lengths", "groups"])
def test_recall(kind):
    rng = np.random.default_rng(4)
    n = 6000
    x = rng.normal(size=(n, 64))
    if kind == "groups":  # a third are near copies of one vector, the rest are in tight groups
        x = np.concatenate([x[:1] + 1e-4 * x[: n // 3], x[rng.integers(0, 50, n - n // 3)] + 0.05 * x[n // 3 :]])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.lognormal(sigma=0.5, size=(n, 1))
    row = ann.index_of(np.arange(n), np.ones(n, np.int32), x, ann.LINKS, ann.BUILD_WIDTH) | {"dim": 64}
    q = x[::60]
    of, ids, score = ann.Shard(row, ann.LINKS).nearest(np.arange(0, n, 60), q, 20, ann.SEARCH_WIDTH * (3 if kind == "lengths" else 1))
    s = q @ x.T
    s[np.arange(len(q)), np.arange(0, n, 60)] = -np.inf
    best = -np.sort(-s, 1)[:, 19]
    good = score >= best[of] - 1e-12
    assert len(ids) == 20 * len(q) and good.mean() >= 0.95


def test_graph_is_flat_and_layered():
    x = ann.lifted(np.random.default_rng(1).normal(size=(700, 8)))
    layers = ann.build(x, links=4, width=32)
    sizes = [s for s, _ in layers]
    assert sizes == sorted(sizes) and sizes[-1] == 700 and len(sizes) > 2
    for size, near in layers:
        assert near.shape == (size, 8 if size == 700 else 4) and near.max() < size
        for i, row in enumerate(near):
            real = row[row >= 0]
            assert i not in real and len(set(real)) == len(real)
    assert ann.build(x[:0]) == [] and [s for s, _ in ann.build(x[:1])][-1] == 1
