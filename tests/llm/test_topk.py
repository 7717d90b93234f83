import math

import numpy as np
from pyspark.sql import functions as F

from tablescape.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(64 * float(np.float32(v))) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = set()
    for qi, q in ok:
        if qi % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in ok if ci != qi and len(c) == len(q))[:k]
            out |= {(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(best)}
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_TILE", 3)
    monkeypatch.setattr(topk, "SHARD", 9)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=5).round(1)]) for i in range(200)]
    rows[40] = (40, None)
    rows[41] = (41, [1.0, None, 0.0, 0.0, 0.0])
    rows[42] = (42, [1.0, float("nan"), 0.0, 0.0, 0.0])
    rows[43] = (43, [1.0, float("inf"), 0.0, 0.0, 0.0])
    rows[60] = (60, [1.0, 2.0])
    rows[61] = (61, [-1.0, 2.0])
    rows[80] = (80, [])
    for i in range(100, 130):
        rows[i] = (i, [0.5] * 5)
    rows.append((None, [1.0] * 5))
    df = spark.createDataFrame([(i, x, "clash", 0) for i, x in rows], "vec_id bigint, embedding array<float>, rank string, score int")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op5_top_k(df).collect()}
    assert got == brute(rows, 20)
    assert topk.op5_top_k(df.where("false")).count() == 0
    assert topk.exact_top_k(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_large_components(spark):
    def top(rows):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        return [(r["vec_id"], r["score"]) for r in topk.exact_top_k(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()]

    # beyond doubles, within a long: exact
    n = 64 * 10**7
    assert top([(0, [1e7, 3.0]), (1, [1e7, -5.0]), (2, [1e7, -4.0]), (3, [1.0, 1.0])]) == [(2, n * n - 192 * 256), (1, n * n - 192 * 320), (3, n * 64 + 192 * 64)]
    # beyond a long: held to its end, where ties go to the smaller id
    assert top([(0, [1e9, 3.0]), (1, [1e9, -5.0]), (2, [2e9, 1.0]), (3, [1e18, 1.0])]) == [(i, 2**63 - 1) for i in (1, 2, 3)]
