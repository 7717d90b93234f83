"""The gap statistic: k-means of the points and of seeded null references, for all numbers of clusters in the same passes.

A pass is one reading of the points. A task draws its rows of every reference
from a counter (row, reference, dimension), so they are the same at every
pass and any partitioning, and are never stored. It adds up, for every
reference and number of clusters, what the new centres need.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.session import stage

#: References; passes at most; change of a cost that ends them; points on which centres start (by hash, at most so many come to the driver).
REFERENCES, PASSES, SETTLED, SAMPLE = 15, 20, 1e-4, 2048
#: The range of numbers of clusters that is aimed at, and how near the elbow must be to win.
TARGET, NEAR_ELBOW = (10, 18), 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def drawn(row: np.ndarray, reference: int, low: np.ndarray, span: np.ndarray, seed: int) -> np.ndarray:
    """The rows' points of a reference: uniform over each dimension's range."""
    dims = np.arange(len(low), dtype=np.uint64)
    with np.errstate(over="ignore"):
        start = _mixed(_mixed(row.view(np.uint64)) + np.uint64(seed * 1_000_003 + reference))
        bits = _mixed(start[:, None] + dims[None] * np.uint64(0xD1342543DE82EF95))
    return low + (bits >> np.uint64(11)) * 2.0**-53 * span


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None]
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(x)), at], 0)


def started(x: np.ndarray, k: int, seed: int, tries: int = 4, rounds: int = 15) -> np.ndarray:
    """Centres by k-means++ and some rounds on the sample, the best of ``tries``."""
    best, least = None, math.inf
    for t in range(tries):
        rng = np.random.default_rng([seed, k, t])
        c = x[[rng.integers(len(x))]]
        d = _nearest(x, c)[1]
        while len(c) < k:
            p = d.sum()
            c = np.concatenate([c, x[[rng.choice(len(x), p=d / p if p > 0 else None)]]])
            d = np.minimum(d, _nearest(x, c[-1:])[1])
        for _ in range(rounds):
            at, d = _nearest(x, c)
            n = np.bincount(at, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        cost = _nearest(x, c)[1].sum()
        if cost < least:
            best, least = c, cost
    return best


def costs(points: DataFrame, id_: str, vector: str, ks: list[int], references: int = REFERENCES, seed: int = 1, passes: int = PASSES) -> tuple[dict[tuple[int, int], float], int]:
    """The k-means cost of each (reference, k), the points themselves being reference 0, and the number of points.

    Vectors that are null or hold null or non-finite components take no part;
    equal vectors under one id draw the same reference points.
    """
    v = F.col(vector).cast("array<double>")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    x = stage(points.where(ok).select(F.xxhash64(F.col(id_), v).alias("row"), v.alias("v")), "gap")
    spans = x.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d").collect()  # a row a dimension
    low, span = np.array([r["lo"] for r in spans]), np.array([r["hi"] - r["lo"] for r in spans])
    few = x.orderBy("row").limit(SAMPLE).collect()
    if not few:
        return {}, 0
    row, real = np.array([r["row"] for r in few]), np.array([r["v"] for r in few])
    of = lambda rows, own, r: own if r == 0 else drawn(rows, r, low, span, seed)
    slots = [(r, k) for r in range(references + 1) for k in ks]
    centres = {(r, k): started(of(row, real, r), k, seed) for r, k in slots}
    dim, n = len(low), x.count()
    schema = "slot int, part int, n array<double>, sums array<double>, cost double"

    def run(batches, centres):
        total = {}
        for batch in batches:
            rows = batch.column(0).to_numpy()
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for s, (r, k) in enumerate(slots):
                if s == 0 or slots[s - 1][0] != r:
                    at_r = of(rows, own, r)
                at, d = _nearest(at_r, centres[r, k])
                hot = np.zeros((len(at), k))
                hot[np.arange(len(at)), at] = 1
                got = (hot.sum(0), hot.T @ at_r, d.sum())
                total[s] = got if s not in total else tuple(a + b for a, b in zip(total[s], got))
        if total:
            part = int(_mixed(np.array([rows[0]]).view(np.uint64))[0] % np.uint64(64))
            yield pa.RecordBatch.from_pylist([{"slot": s, "part": part, "n": a.tolist(), "sums": b.ravel().tolist(), "cost": float(c)} for s, (a, b, c) in total.items()], schema=pa.schema([("slot", pa.int32()), ("part", pa.int32()), ("n", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64())), ("cost", pa.float64())]))

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [np.sum(list(pdf["n"]), 0)], "sums": [np.sum(list(pdf["sums"]), 0)], "cost": [pdf["cost"].sum()]})

    last: dict[tuple[int, int], float] = {}
    for at in range(passes):
        now = dict(centres)
        sums = x.mapInArrow(lambda batches, now=now: run(batches, now), schema)
        sums = sums.groupBy("slot", "part").applyInPandas(added, schema).groupBy("slot").applyInPandas(added, schema)
        cost = {}
        for r in sums.collect():  # a row a reference and number of clusters
            key = slots[r["slot"]]
            count, s = np.array(r["n"]), np.array(r["sums"]).reshape(-1, dim)
            centres[key] = np.where(count[:, None] > 0, s / np.maximum(count, 1)[:, None], now[key])
            cost[key] = r["cost"]
        done = last and all(last[k] - cost[k] <= SETTLED * max(last[k], 1e-300) for k in cost)
        last = cost
        if done:
            break
    return last, n


def gap_curve(points: DataFrame, id_: str, vector: str, ks: list[int], references: int = REFERENCES, seed: int = 1, compat: bool = False) -> DataFrame:
    """(k, within, expected, gap, deviation, curvature, stops): the gap statistic of each number of clusters, ascending.

    ``within`` is the sum of squared distances to the centres, ``expected`` its
    mean over the references, ``gap`` the mean log cost of the references less
    the log cost of the points (``compat``: the log of the mean), ``deviation``
    the references' with its simulation error, ``curvature`` the second
    difference of the gap (null at the ends), and ``stops`` whether the gap is
    not below the next one less its deviation. Numbers of clusters above the
    number of points go; without points the curve is empty.
    """
    spark = points.sparkSession
    ks = sorted({k for k in ks if k >= 1})
    found, n = costs(points, id_, vector, ks, references, seed)
    rows = []
    for k in ks if found else []:
        if k <= n:
            of = [found[r, k] for r in range(1, references + 1)]
            logs = [math.log(max(c, 1e-300)) for c in of]
            mean = math.log(max(sum(of) / len(of), 1e-300)) if compat else sum(logs) / len(logs)
            middle = sum(logs) / len(logs)
            deviation = math.sqrt(sum((v - middle) ** 2 for v in logs) / len(logs) * (1 + 1 / len(logs)))
            rows.append((k, float(found[0, k]), float(sum(of) / len(of)), mean - math.log(max(found[0, k], 1e-300)), deviation))
    w = Window.orderBy("k")  # a few rows
    near = lambda c, by: F.lead(c, by).over(w) if by > 0 else F.lag(c, -by).over(w)
    curve = spark.createDataFrame(rows, "k int, within double, expected double, gap double, deviation double")
    return curve.withColumn("curvature", near("gap", 1) - 2 * F.col("gap") + near("gap", -1)).withColumn("stops", F.col("gap") >= near("gap", 1) - near("deviation", 1))


def one_deviation_k(curve: DataFrame) -> int | None:
    """The least k whose gap is not below the next one less its deviation; without one that of the greatest gap."""
    row = curve.orderBy(F.desc(F.coalesce("stops", F.lit(False))), F.when(F.coalesce("stops", F.lit(False)), F.col("k")), F.desc("gap"), "k").first()
    return row["k"] if row else None


def elbow_k(curve: DataFrame) -> int | None:
    """The k of the greatest absolute second difference, the first k where there is none."""
    row = curve.orderBy(F.desc(F.abs(F.coalesce("curvature", F.lit(0.0)))), "k").first()
    return row["k"] if row else None


def targeted_k(curve: DataFrame, target: tuple[int, int] = TARGET) -> int:
    """The k of the greatest gap within ``target``, or the elbow there if it is within ``NEAR_ELBOW`` of it.

    Without a k in the target the greatest gap of all, held to the target; the
    middle of it without a curve. The elbow is that of the part of the curve in
    the target.
    """
    low, high = target
    if curve.isEmpty():
        return (low + high) // 2
    inside = curve.where(F.col("k").between(low, high))
    best = (curve if inside.isEmpty() else inside).orderBy(F.desc("gap"), "k").first()["k"]
    if inside.isEmpty():
        return max(low, min(high, best))
    w = Window.orderBy("k")
    elbow = elbow_k(inside.withColumn("curvature", F.lead("gap").over(w) - 2 * F.col("gap") + F.lag("gap").over(w)))
    return elbow if abs(elbow - best) <= NEAR_ELBOW else best
