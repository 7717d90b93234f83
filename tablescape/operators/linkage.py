"""Average-linkage agglomeration with a size limit, many merges a round.

Average linkage is reducible: merging two clusters never brings them nearer to
a third than the nearer of both was. Clusters that are each other's nearest
may therefore all merge at once, and the tree is that of one merge at a time.
A size limit keeps this, as a merge that is too large stays too large. Ties
follow a key of the pair; the merged pair has the least key of its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.functions.stats import order_statistic
from tablescape.operators.components import connected_components
from tablescape.session import stage

#: Nodes in a cluster at most, and what keeps the inverse of a weight finite.
MOST_NODES, LEAST_WEIGHT = 25, 1e-6


def inverse_weights(edges: DataFrame) -> DataFrame:
    """(a, b, distance), a < b: the inverse of the greatest weight between two nodes; self-loops go."""
    pair = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.agg((1 / (F.max("weight") + LEAST_WEIGHT)).alias("distance"))


def average_linkage(distances: DataFrame, most: int | None = MOST_NODES, missing: float | None = None, max_rounds: int = 500) -> DataFrame:
    """(a, b, height, key, n, round): the merges of average linkage over (a, b, distance), a < b, once a pair; ``b`` joins ``a``, which names the cluster of ``n`` nodes.

    A pair that is not listed is infinitely far apart, so that two clusters of
    which one pair is not listed never merge; with ``missing`` it is so far
    apart. No cluster grows beyond ``most`` nodes. Heights never fall on the
    way up, and neither do (height, key). Pairs with a null end or distance go;
    an empty table gives no merges.

    A round takes each cluster's nearest by an aggregate that is combined
    before the shuffle, merges those that are each other's, and sums the
    distances between the new clusters. Pairs that can never merge, as one of
    their pairs is not listed or they are too large together, go at once. It is
    written, so a lost executor costs a read. More than ``max_rounds`` rounds raise an error.
    """
    spark = distances.sparkSession
    pairs = distances.where("a IS NOT NULL AND b IS NOT NULL AND distance IS NOT NULL AND a <> b")
    e = stage(pairs.select("a", "b", F.col("distance").cast("double").alias("s"), F.lit(1).cast("bigint").alias("c"), F.xxhash64("a", "b").alias("key"), F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb")), "linkage")
    merges, full = None, F.col("na") * F.col("nb")
    # neither is ever mended: what is missing or too large stays so in all that a cluster becomes part of
    can = (F.lit(True) if most is None else F.col("na") + F.col("nb") <= most) & (F.col("c") == full if missing is None else F.lit(True))
    for at in range(max_rounds):
        mean = F.col("s") / full if missing is None else (F.col("s") + missing * (full - F.col("c"))) / full
        able = e.where(can)
        able = able.select("a", "b", mean.alias("height"), "key", (F.col("na") + F.col("nb")).alias("n"))
        both = able.select(F.explode(F.array("a", "b")).alias("node"), F.struct("height", "key", "a", "b", "n").alias("p"))
        nearest = both.groupBy("node").agg(F.min("p").alias("p"))
        found = nearest.groupBy("p").agg(F.count("*").alias("sides")).where("sides = 2").select("p.a", "p.b", "p.height", "p.key", "p.n", F.lit(at).alias("round"))
        found = stage(found, "merges")
        if found.isEmpty():
            break
        merges = found if merges is None else merges.unionByName(found)
        to = found.select(F.col("b").alias("old"), F.col("a").alias("new"), "n").unionByName(found.select(F.col("a").alias("old"), F.col("a").alias("new"), "n"))

        def renamed(df, end):
            j = df.join(to.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}"), F.col("n").alias(f"n_{end}")), end, "left")
            return j.withColumns({end: F.coalesce(f"new_{end}", end), f"n{end}": F.coalesce(f"n_{end}", f"n{end}")}).drop(f"new_{end}", f"n_{end}")

        moved = renamed(renamed(e, "a"), "b").where("a <> b")
        swap = F.col("a") > F.col("b")
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", "c", "key", F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        e = stage(moved.groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.min("key").alias("key"), F.max("na").alias("na"), F.max("nb").alias("nb")).where(can), "linkage")
    else:
        raise RuntimeError(f"linkage did not end in {max_rounds} rounds")
    return merges if merges is not None else spark.createDataFrame([], found.schema)


def cut(merges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, cluster): the clusters after the first merges by (height, key) that leave ``k``, or after all where there are fewer; a cluster has its least node's name."""
    n, m = nodes.select("node").distinct().count(), merges.count()
    take = max(0, min(m, n - k))
    if take < m:
        height = order_statistic(merges, "height", take) if take else None
        below = merges.where(F.col("height") < height) if take else merges.where("false")
        rest = take - below.count()
        level = merges.where(F.col("height") == height) if rest else below
        merges = below.unionByName(level.where(F.col("key") <= order_statistic(level, "key", rest))) if rest else below
    comps = connected_components(merges, "a", "b")
    return nodes.select("node").distinct().join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def forced(membership: DataFrame, k: int) -> DataFrame:
    """(node, cluster): the ``k`` largest clusters stay (ties by name), the nodes of all others go to the least of these."""
    sizes = membership.groupBy("cluster").agg(F.count("*").alias("n"))
    kept = sizes.orderBy(F.desc("n"), "cluster").limit(k)  # a few rows
    rows = kept.collect()
    if not rows:
        return membership
    last = rows[-1]["cluster"]
    keep = [r["cluster"] for r in rows]
    return membership.select("node", F.when(F.col("cluster").isin(keep), F.col("cluster")).otherwise(F.lit(last)).alias("cluster"))


def agglomerated(edges: DataFrame, nodes: DataFrame, k: int, most: int = MOST_NODES) -> DataFrame:
    """(node, cluster): average linkage over inverse edge weights down to ``k`` clusters of at most ``most`` nodes; where no two may merge any more, the rest is forced, whatever its size."""
    found = stage(cut(average_linkage(inverse_weights(edges), most), nodes, k), "linked")
    return forced(found, k) if found.select("cluster").distinct().count() > k else found
