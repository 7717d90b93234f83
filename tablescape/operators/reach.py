"""How far DBSCAN reaches: distances to the k-th neighbour, their knee, a predicted reach and a search around it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.functions.stats import order_statistic, order_statistics
from tablescape.operators import clustering
from tablescape.operators.blocks import against_all, vectors
from tablescape.session import stage

#: The share of the distances that is the predicted reach, its bounds, and the factors that are tried.
SHARE, LEAST_REACH, MOST_REACH, FACTORS = 0.15, 0.1, 1.0, (0.8, 1.0, 1.2)
#: Clusters aimed at, and the share of noise that is too much.
TARGET, MOST_NOISE = (10, 20), 0.15
#: Scores that end the search: of the predicted reach, and of any other.
GOOD, EXCELLENT = 0.7, 0.8
#: Pairs that fan in to one comparison of differences, in thousands.
FAN_IN = 64


def neighbour_distances(points: DataFrame, id_: str, vector: str, k: int, block: int | None = None) -> DataFrame:
    """(node, distance): each point's Euclidean distance to its ``k``-th nearest other point; points with fewer others go.

    A task holds a block of points with the k least distances that each has met
    so far, while all points pass by (``blocks.against_all``). A product gives
    a lower bound of each distance; only what is below a point's k-th least is
    taken from differences, so equal points are 0 apart. The work is quadratic.
    Null ids, and vectors that are null or hold null or non-finite components,
    go: they are near nothing.
    """
    v = F.col(vector) if points.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    v = points.select(F.col(id_).alias("node"), v.alias("v")).where("node IS NOT NULL AND v IS NOT NULL")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    kind = v.schema["node"].dataType.simpleString()
    v, step = v.select(F.monotonically_increasing_id().alias("row"), "node", "v"), FAN_IN * 1000

    def held(own, others):
        x, rows, best = vectors(own, 2), own.column(0).to_numpy(), np.full((own.num_rows, k), np.inf)
        order = np.argsort(rows)
        blur = 4 * (x.shape[1] + 4) * np.finfo(float).eps
        xx = (x * x).sum(1)[:, None]
        left = np.hstack([-2 * x, (1 - blur) * xx, np.ones_like(xx)])

        def improved(best, a, y, i, j):
            """``best`` of the points ``a`` after the pairs (i, j), a slice of them at a time."""
            for at in range(0, len(i), step):
                p, q = i[at : at + step], j[at : at + step]
                d = np.sqrt(((a[p] - y[q]) ** 2).sum(1))
                by = np.lexsort([d, p])
                p, d = p[by], d[by]
                firsts = np.flatnonzero(np.diff(p, prepend=-1))
                rank = np.arange(len(p)) - np.repeat(firsts, np.diff(np.append(firsts, len(p))))
                some, new = p[firsts], np.full((len(firsts), k), np.inf)
                keep = rank < k
                new[np.searchsorted(some, p[keep]), rank[keep]] = d[keep]
                best[some] = np.sort(np.hstack([best[some], new]), 1)[:, :k]

        for batch, is_own in others:
            y = vectors(batch, 2)
            yy = (y * y).sum(1)[:, None]
            right = np.ascontiguousarray(np.hstack([y, np.ones_like(yy), (1 - blur) * yy]).T)
            place = order[np.searchsorted(rows, batch.column(0).to_numpy(), sorter=order)] if is_own else None
            for at in range(0, len(x), 256):
                a, b = x[at : at + 256], best[at : at + 256]
                low = left[at : at + 256] @ right
                if is_own:
                    here = np.flatnonzero((place >= at) & (place < at + len(a)))
                    low[place[here] - at, here] = np.inf
                some = np.flatnonzero(np.isinf(b[:, -1]))
                if len(some):  # the first that pass by
                    m = min(k, low.shape[1])
                    j = np.argpartition(low[some], m - 1, 1)[:, :m]
                    i, j = np.repeat(some, m), j.ravel()
                    met = np.isfinite(low[i, j])
                    i, j = i[met], j[met]
                    improved(b, a, y, i, j)
                    low[i, j] = np.inf
                # k copies cannot be bettered
                found = np.flatnonzero(low < np.where(b[:, -1] > 0, b[:, -1] ** 2, -np.inf)[:, None])
                improved(b, a, y, found // low.shape[1], found % low.shape[1])
        enough = np.flatnonzero(np.isfinite(best[:, -1]))
        yield pa.RecordBatch.from_arrays([own.column(1).take(pa.array(enough)), pa.array(best[enough, -1])], ["node", "distance"])

    return against_all(v, held, f"node {kind}, distance double", block=block)


def knee(distances: DataFrame, value: str = "distance", points: int = 256) -> DataFrame:
    """One row (rank, value): where the sorted values lie farthest below the line from their least to their greatest, on a grid of ``points`` ranks; the least where none does."""
    spark = distances.sparkSession
    v = stage(distances.select(value).where(F.col(value).isNotNull()), "knee")
    n = v.count()
    if not n:
        return spark.createDataFrame([], "rank bigint, value double")
    ranks = sorted({round(i * (n - 1) / max(1, points - 1)) for i in range(points)} | {0, n - 1})
    at = stage(order_statistics(v, value, spark.createDataFrame([(r,) for r in ranks], "rank bigint")), "knee")  # a few rows
    ends = at.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    below = F.col("rank") / max(1, n - 1) - (F.col("value") - F.col("lo")) / span
    return at.crossJoin(ends).withColumn("below", F.round(below, 12)).orderBy(F.desc("below"), "rank").limit(1).select("rank", F.col("value").cast("double").alias("value"))  # one row of ends


def predicted(pairs: DataFrame, n: int) -> tuple[float, int]:
    """Reach and least number of partners for (a, b, distance) over ``n`` nodes: the distance at ``SHARE`` of the positive ones, held to its bounds; 3 to 5 partners by the number of nodes. Without distances .5 and 3."""
    positive = pairs.where(F.col("distance") > 0)
    m = positive.count()
    if not m:
        return 0.5, 3
    # each pair stands twice in a matrix, so the index over both halves is halved
    at = order_statistic(positive, "distance", min(m, int(2 * m * SHARE) // 2 + 1))
    return max(LEAST_REACH, min(MOST_REACH, at)), 3 if n < 50 else 4 if n < 200 else 5


def candidates(reach: float, least: int, most: int = 6) -> list[tuple[float, int]]:
    """The settings around a prediction, nearest first: its factors, and one partner less and more."""
    tried = [(e, p) for e in (reach * f for f in FACTORS) for p in (max(2, least - 1), least, least + 1) if LEAST_REACH <= e <= MOST_REACH and 2 <= p <= 6 and (e, p) != (reach, least)]
    return sorted(tried, key=lambda c: abs(c[0] - reach) + abs(c[1] - least))[:most]


def score(membership: DataFrame) -> float:
    """How good (node, cluster), null for noise, is: .4 for a number of clusters in ``TARGET``, .2 for even sizes, .2 for coverage, .2 for sizes of 3 to 20; 0 without a cluster or with too much noise."""
    sizes = membership.groupBy("cluster").agg(F.count("*").alias("n"))
    r = sizes.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("cluster").isNull(), F.col("n"))).alias("noise"), *[f(F.when(F.col("cluster").isNotNull(), F.col("n"))).alias(c) for f, c in ((F.count, "k"), (F.min, "least"), (F.max, "most"), (F.avg, "mean"))]).first()
    noise = r["noise"] or 0
    if not r["k"] or noise > r["all"] * MOST_NOISE:
        return 0.0
    off = 0 if TARGET[0] <= r["k"] <= TARGET[1] else min(abs(r["k"] - t) for t in TARGET)
    of_size = 1.0 if 3 <= r["mean"] <= 20 else max(0.0, 1 - abs(r["mean"] - 8) / 15)
    return max(0.0, 0.4 - off / 10) + 0.2 * (1 - (r["most"] - r["least"]) / r["most"]) + 0.2 * (1 - noise / r["all"]) + 0.2 * of_size


def searched(pairs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, dict]:
    """(node, cluster, role) of the best setting found, and {reach, least, score, tried}.

    The predicted setting ends the search above ``GOOD``; else those around it
    are tried, nearest first, unless they ask for half of the nodes, until one
    is above ``EXCELLENT``. Ties stay with the earlier. Every run is written.
    """
    n = nodes.count()
    reach, least = predicted(pairs, n)
    run = lambda e, p: stage(clustering.dbscan(pairs.where(F.col("distance") <= e), nodes, p), "dbscan-run")
    best = run(reach, least)
    found = {"reach": reach, "least": least, "score": score(best), "tried": 1}
    if found["score"] <= GOOD:
        for e, p in candidates(reach, least):
            if p >= n / 2:
                continue
            got = run(e, p)
            s = score(got)
            found["tried"] += 1
            if s > found["score"]:
                best, found = got, found | {"reach": e, "least": p, "score": s}
            if s > EXCELLENT:
                break
    return best, found
