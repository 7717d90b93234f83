"""The gap statistic against numpy: the same costs pass by pass, the planted number of clusters, the rules on a given curve."""

import math

import numpy as np
import pytest

from tablescape.operators import gap


def blobs(n, k, dim=4, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)) * 0.25 + rng.permutation(np.eye(dim) * 6)[np.arange(n) % k] + (np.arange(n) % k)[:, None]


def lloyd(x, k, seed, passes=60):
    best = math.inf
    for t in range(8):
        rng = np.random.default_rng([seed, t, k])
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(passes):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            at = d.argmin(1)
            c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
        best = min(best, ((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum())
    return best


def test_planted_clusters_and_costs(spark):
    x = blobs(400, 4)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    curve = gap.gap_curve(df, "id", "v", [1, 2, 3, 4, 5, 6, 4000], references=15)
    got = {r["k"]: r for r in curve.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[1]["within"] == pytest.approx(((x - x.mean(0)) ** 2).sum(), rel=1e-9)
    for k in (2, 3, 4):
        assert got[k]["within"] == pytest.approx(lloyd(x, k, 1), rel=1e-3)
    # the references' costs against numpy's own references
    rng = np.random.default_rng(0)
    for k in (1, 3):
        own = [lloyd(x.min(0) + rng.random(x.shape) * (x.max(0) - x.min(0)), k, b) for b in range(6)]
        assert abs(math.log(got[k]["expected"]) - math.log(np.mean(own))) < 0.05
    assert gap.one_deviation_k(curve) == 4 and gap.elbow_k(curve) == 4 and gap.targeted_k(curve, (3, 6)) == 4 and gap.targeted_k(curve, (10, 18)) == 10
    assert got[1]["curvature"] is None and got[3]["curvature"] == pytest.approx(got[4]["gap"] - 2 * got[3]["gap"] + got[2]["gap"])
    wide = gap.costs(df.repartition(7), "id", "v", [2], references=2)[0]
    assert wide == pytest.approx(gap.costs(df.coalesce(1), "id", "v", [2], references=2)[0], rel=1e-9)


def test_rules(spark):
    curve = lambda gaps, dev=0.01, at=1: spark.createDataFrame([(i + at, 1.0, 1.0, g, dev) for i, g in enumerate(gaps)], "k int, within double, expected double, gap double, deviation double")
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    def whole(c):
        w = Window.orderBy("k")
        return c.withColumn("curvature", F.lead("gap").over(w) - 2 * F.col("gap") + F.lag("gap").over(w)).withColumn("stops", F.col("gap") >= F.lead("gap").over(w) - F.lead("deviation").over(w))

    assert gap.one_deviation_k(whole(curve([0.1, 0.5, 0.9, 0.905, 1.4]))) == 3
    assert gap.one_deviation_k(whole(curve([0.1, 0.2, 0.4]))) == 3  # never stops: the greatest
    assert gap.elbow_k(whole(curve([0.1, 0.2, 0.9, 1.2]))) == 2
    assert gap.targeted_k(whole(curve([0.1, 0.4, 0.9, 1.0, 1.01], at=10))) == 12  # the elbow is within 2 of the best, 14
    assert gap.targeted_k(whole(curve([0.9, 0.1, 0.2, 0.3, 0.4], at=10))) == 11
    assert gap.targeted_k(whole(curve([0.9, 0.1], at=30))) == 18
    empty = spark.createDataFrame([], "id int, v array<double>")
    assert gap.gap_curve(empty, "id", "v", [1, 2]).count() == 0 and gap.targeted_k(curve([])) == 14
