"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.session import stage


def spanning(links: DataFrame) -> DataFrame:
    """Of (a, b, whole) the rows with ``whole``, and of the others those of a spanning forest of each partition, which links the same nodes.

    What leaves a partition is less than its nodes, however many its links.
    A batch is held against the forest at once; only links that join two of its
    trees are walked one by one.
    """

    def run(batches):
        names, root = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, whole = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            own = np.flatnonzero(~whole.astype(bool))
            kept = [np.flatnonzero(whole)]
            if len(own):
                met = np.unique(np.concatenate([a[own], b[own]]))
                new = met if names is None else met[names[np.minimum(np.searchsorted(names, met), len(names) - 1)] != met]
                if len(new):
                    all_ = new if names is None else np.concatenate([names, new])
                    order = np.argsort(all_, kind="stable")
                    place = np.empty(len(order), np.int64)
                    place[order] = np.arange(len(order))
                    names, root = all_[order], place[np.concatenate([root, np.arange(len(root), len(all_))])][order]
                x, y = root[np.searchsorted(names, a[own])], root[np.searchsorted(names, b[own])]
                up: dict[int, int] = {}

                def top(i):
                    while i in up:
                        up[i] = i = up.get(up[i], up[i])
                    return i

                joins = []
                for at in np.flatnonzero(x != y).tolist():
                    i, j = top(int(x[at])), top(int(y[at]))
                    if i != j:
                        up[i] = j
                        joins.append(at)
                if joins:
                    ends = np.array(list(up), np.int64)
                    to = np.arange(len(root))
                    to[ends] = [top(i) for i in ends.tolist()]
                    root = to[root]
                    kept.append(own[joins])
            rows = np.concatenate(kept)
            if len(rows):
                yield batch.take(pa.array(rows))

    return links.select("a", "b", "whole").mapInArrow(run, links.select("a", "b", "whole").schema)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of an edge with the smallest node it reaches.

    ``edges`` is undirected; self-loops keep their node, edges with a null end
    are ignored, repeated edges count once, and an empty table gives an empty
    result. Node columns are of one orderable type.

    Each round hangs larger neighbours of a node under its least neighbour and
    then collapses the pointers to smaller ones, so a component becomes a star
    in a logarithmic number of rounds whatever its diameter. The least
    neighbour is an aggregate (combined before the shuffle) joined back to the
    edges, so a node with a great many neighbours is never gathered in one
    task; adaptive execution splits its join partition. Every round is written
    to the shared folder, which cuts the lineage.
    """
    pairs = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node"))
    e = stage(pairs.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "cc")
    seen = _digest(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("lo")).select(F.col("a"), F.least("a", "lo").alias("lo"))
        # large star: neighbours greater than the node go under the node's least neighbour
        e = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("lo").alias("b")).where("a <> b").distinct()
        # small star: the node and its smaller neighbours go under the least of them
        least = e.groupBy("a").agg(F.min("b").alias("lo"))
        e = e.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("lo").alias("b")), F.struct(F.col("b").alias("a"), F.col("lo").alias("b")))).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
        e = stage(e, "cc")
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.distinct().join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
