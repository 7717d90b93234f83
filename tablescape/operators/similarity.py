"""Similarity of vectors: pairs above a threshold by blocks, classes, and coherence of clusters in closed form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescape.operators import blocks
from tablescape.session import stage

# Thresholds of the classes high, medium and low, and those of the lenient mode.
STRICT, LENIENT = (0.85, 0.7, 0.5), (0.7, 0.5, 0.3)
#: Pairs in a batch that leaves a task.
SLICE = 1 << 16


def similarity_class(similarity: Column, lenient: bool = False) -> Column:
    a, b, c = LENIENT if lenient else STRICT
    return F.when(similarity >= a, "high").when(similarity >= b, "medium").when(similarity >= c, "low").otherwise("none")


def unit_vectors(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, u): vectors as doubles of length 1; null and zero vectors have none and go."""
    v = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    v = v.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("n > 0")
    return v.select("id", F.transform("v", lambda x: x / F.col("n")).alias("u"))


def similar_pairs(vectors: DataFrame, id_: str, vector: str, threshold: float, tile: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of a cosine similarity of ``threshold`` at least.

    A task holds a block of ``tile`` vectors while others pass by, two blocks
    meeting once (``blocks.against_all``), and gives the similar pairs a slice
    at a time. Ids are longs. The work is quadratic, its rows are not. Null and
    zero vectors go.
    """
    v = F.col(vector) if vectors.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    v = vectors.select(F.col(id_).cast("long").alias("id"), v.alias("v"))
    v = v.where("id IS NOT NULL AND aggregate(v, 0D, (a, x) -> a + double(x) * double(x)) > 0")

    def units(batch):
        x = blocks.vectors(batch, 1)
        return batch.column(0).to_numpy(), x / np.sqrt((x * x).sum(1))[:, None]

    def held(own, others):
        ia, a = units(own)
        for batch, is_own in others:
            ib, b = units(batch)
            for at in range(0, len(a), 256):
                s = a[at : at + 256] @ b.T
                found = np.flatnonzero(s >= threshold)
                for cut in range(0, len(found), SLICE):
                    i, j = np.divmod(found[cut : cut + SLICE], len(b))
                    x, y, c = ia[at + i], ib[j], s[i, j]
                    if is_own:
                        keep = x < y
                        x, y, c = x[keep], y[keep], c[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(c)], ["a", "b", "similarity"])

    return blocks.against_all(v, held, "a bigint, b bigint, similarity double", half=True, block=tile)


def _sums(vectors: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, dim, s, q): sums and square sums by dimension; combined before the shuffle."""
    return vectors.select(F.col(cluster).alias("cluster"), F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))


def coherence(vectors: DataFrame, id_: str, cluster: str, vector: str) -> DataFrame:
    """(cluster, n, mean_similarity, action): the mean cosine similarity over all pairs of a cluster, without its pairs.

    Of unit vectors with sum S the mean over pairs is (|S|^2 - n) / (n (n-1)).
    The action follows from the score against the mean and deviation over
    clusters: split below one deviation, refine below the mean, merge above
    one deviation, else accept; clusters of one are accepted.
    """
    u = unit_vectors(vectors, id_, vector).join(vectors.select(F.col(id_).alias("id"), F.col(cluster).alias("cluster")), "id")
    n = u.groupBy("cluster").agg(F.count("*").alias("n"))
    s = _sums(u, "cluster", "u").groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    c = n.join(s, "cluster").select("cluster", "n", F.when(F.col("n") > 1, (F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_similarity"))
    all_ = c.agg(F.avg("mean_similarity").alias("m"), F.stddev_pop("mean_similarity").alias("d"))
    x = F.col("mean_similarity")
    action = F.when(x.isNull(), "accept").when(x < F.col("m") - F.col("d"), "split").when(x < F.col("m"), "refine").when(x > F.col("m") + F.col("d"), "merge").otherwise("accept")
    return c.crossJoin(F.broadcast(all_)).select("cluster", "n", "mean_similarity", action.alias("action"))  # one row


def greedy_groups(pairs: DataFrame, nodes: DataFrame, least: int = 2, max_rounds: int = 200) -> DataFrame:
    """(node, leader): the groups that nodes form when, in ascending order, each that is in none founds one and takes all later ones like it that are in none.

    ``pairs`` (a, b) are alike, in either order; ``nodes`` (node) may have more
    nodes. Groups of less than ``least`` go. Founders are the first independent
    set in that order: in a round all nodes found a group that have no earlier
    neighbour left that could, so many decide at once; a node joins the first
    founder that is before it and like it. Rounds are as many as the longest
    chain of such waits; more than ``max_rounds`` raise an error.
    """
    p = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).distinct()
    known = nodes.select("node").where("node IS NOT NULL").distinct()
    all_ = stage(p.join(known.select(F.col("node").alias("early")), "early", "left_semi").join(known.select(F.col("node").alias("late")), "late", "left_semi"), "alike")
    open_, left, leaders = stage(known, "open"), all_, known.where("false")
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        new = stage(open_.join(left.select(F.col("late").alias("node")), "node", "left_anti"), "leaders")
        leaders = leaders.unionByName(new)
        taken = left.join(new.select(F.col("node").alias("early")), "early", "left_semi").select(F.col("late").alias("node"))
        open_ = stage(open_.join(new, "node", "left_anti").join(taken, "node", "left_anti"), "open")
        still = left.join(open_.select(F.col("node").alias("early")), "early", "left_semi").join(open_.select(F.col("node").alias("late")), "late", "left_semi")
        left = stage(still, "alike")
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    leaders = stage(leaders.unionByName(open_), "leaders")
    joined = all_.join(leaders.select(F.col("node").alias("early")), "early", "left_semi").join(leaders.select(F.col("node").alias("late")), "late", "left_anti")
    groups = joined.groupBy(F.col("late").alias("node")).agg(F.min("early").alias("leader")).unionByName(leaders.select("node", F.col("node").alias("leader")))
    large = groups.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return groups.join(large.select("leader"), "leader", "left_semi").select("node", "leader")
