"""Communities by local moving and contraction, in parallel moves that never lower modularity.

In a round every cluster either gives or takes, by a hash of its name and the
round. Nodes of givers move to the taker of the greatest gain. Gains of moves
that share no cluster add up; two moves out of one cluster, or into one, lose
at most the product of their degrees over twice the squared total weight. A
move is made if its gain is above that loss against all moves that are tried
before it in its two clusters, so the sum of what is made is a true gain.

Nodes lie in parts by ranges of their names. A level's edges are packed once, a
row a part, in buckets by part; a round shuffles rows by nodes, and the cluster
of a node once for each part that it has neighbours in, but no edges.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablescape.session import stage, stage_buckets

#: Steps of gain by degree, and parts of a step, in which moves of a cluster are tried: a window holds so many rows at most.
STEPS, PARTS = 64, 16
#: Ends of edges in a part of the graph, on average, and the most buckets that parts are written in.
PART_ENDS, MOST_BUCKETS = 1 << 19, 200


class Packed(NamedTuple):
    """A graph in parts: ``places`` (node, part, pos); ``graph``, a row a part; ``sends`` (part, to, ids), the places of a part that have neighbours in the part ``to``."""

    places: DataFrame
    graph: DataFrame
    sends: DataFrame


def _bytes(x: np.ndarray) -> pa.Array:
    """One row that is the bytes of ``x``."""
    return pa.array([x.tobytes()], pa.binary())


def _numbers(table: pa.Table, name: str, at: int, kind) -> np.ndarray:
    return np.frombuffer(table.column(name)[at].as_buffer(), kind)


def _packed(pairs: DataFrame, nodes: DataFrame) -> Packed:
    """Of (a, b, w), each unordered pair of different nodes once, and all ``nodes``.

    A row of ``graph`` has an edge's end in the part in ``pos``, its weight in
    ``w``, and in ``j`` the place of its other end in ``halo``: the part (times
    2^32) and place of every neighbour, ascending.
    """
    parts = max(1, min(math.ceil(2 * pairs.count() / PART_ENDS), nodes.count()))
    ranged = stage(nodes.select("node").repartitionByRange(parts, "node").select("node", F.spark_partition_id().alias("part")), "ranges")
    places = stage(ranged.select("node", "part", (F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1).alias("pos")), "places")
    end = lambda c: places.select(F.col("node").alias(c), F.struct("part", "pos").alias(f"at_{c}"))
    e = pairs.join(end("a"), "a").select("b", "at_a", "w").join(end("b"), "b")
    e = e.select("at_a.part", "at_a.pos", F.col("at_b.part").alias("part_b"), F.col("at_b.pos").alias("pos_b"), "w")

    def ends(key, edges):
        """The ends of the edges that a part's nodes are first of, packed for the parts that they lie in."""
        part = key[0].as_py()
        pos, part_b, pos_b, w = (edges.column(c).to_numpy() for c in ("pos", "part_b", "pos_b", "w"))
        to = np.append(np.full(len(pos), part, part_b.dtype), part_b)
        order = np.argsort(to, kind="stable")
        there = np.append(pos, pos_b).astype(np.int32)[order]
        other = np.append((part_b.astype(np.int64) << 32) | pos_b, (np.int64(part) << 32) | pos.astype(np.int64))[order]
        found, first = np.unique(to[order], return_index=True)
        rows = zip(found.tolist(), np.split(there, first[1:]), np.split(other, first[1:]), np.split(np.append(w, w).astype(np.float64)[order], first[1:]))
        return pa.concat_tables([pa.Table.from_arrays([pa.array([at], pa.int32()), *map(_bytes, columns)], ["part", "pos", "other", "w"]) for at, *columns in rows])

    def pack(key, packed):
        pos, other, w = (np.concatenate([_numbers(packed, c, at, t) for at in range(packed.num_rows)]) for c, t in (("pos", np.int32), ("other", np.int64), ("w", np.float64)))
        halo, j = np.unique(other, return_inverse=True)
        order = np.lexsort((j, pos))
        columns = [pos[order], j[order].astype(np.int32), w[order], halo]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *map(_bytes, columns)], ["part", "pos", "j", "w", "halo"])

    def wanted(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                halo, to = np.frombuffer(batch.column("halo")[at].as_buffer(), np.int64), batch.column("part")[at].as_py()
                for part, ids in zip(*_runs(halo)):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([to], pa.int32()), _bytes(ids)], ["part", "to", "ids"])

    def _runs(halo):
        part, first = np.unique(halo >> 32, return_index=True)
        return part, np.split((halo & 0xFFFFFFFF).astype(np.int32), first[1:])

    buckets = min(parts, MOST_BUCKETS)
    packed = e.groupBy("part").applyInArrow(ends, "part int, pos binary, other binary, w binary")
    graph = stage_buckets(packed.groupBy("part").applyInArrow(pack, "part int, pos binary, j binary, w binary, halo binary"), "packed", "part", buckets)
    sends = stage_buckets(graph.select("part", "halo").mapInArrow(wanted, "part int, to int, ids binary"), "sends", "part", buckets)
    return Packed(places, graph, sends)


def _sent(placed: DataFrame, sends: DataFrame) -> DataFrame:
    """The nodes of each part (``at`` null), and the clusters of their neighbours in the part ``at``."""
    name = T.ArrayType(placed.schema["node"].dataType)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("nodes", name), T.StructField("clusters", name), *[T.StructField(c, T.BinaryType()) for c in ("k", "all", "gives")]])

    def run(key, nodes, wanted):
        nodes = nodes.sort_by("pos").combine_chunks()
        name, cluster = (nodes.column(c).combine_chunks() for c in ("node", "cluster"))
        k, total, gives = (nodes.column(c).to_numpy() for c in ("k", "all", "gives"))
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        row = lambda to, at, who, *rest: pa.Table.from_arrays([pa.array([to], pa.int32()), pa.array([at], pa.int32()), *map(listed, who), *map(_bytes, rest)], schema.names)
        part = key[0].as_py()
        rows = [row(part, None, (name, cluster), k, total, gives)]
        for at in range(wanted.num_rows):
            ids = _numbers(wanted, "ids", at, np.int32)
            rows.append(row(wanted.column("to")[at].as_py(), part, (name.slice(0, 0), cluster.take(pa.array(ids))), k[:0], total[ids], gives[ids]))
        return pa.concat_tables(rows)

    return placed.groupBy("part").cogroup(sends.groupBy("part")).applyInArrow(run, schema)


def _ranked(sent: pa.Table) -> tuple[pa.Table, pa.Array, np.ndarray]:
    """The rows of ``sent``, the part's own first, the names of all clusters in them in order, and the rank of the cluster of each node and neighbour."""
    sent = sent.take(pc.sort_indices(sent, sort_keys=[("at", "ascending")], null_placement="at_start"))
    clusters = pa.chunked_array([x.values for x in sent.column("clusters")]).combine_chunks().dictionary_encode()
    ranked = pc.sort_indices(clusters.dictionary)
    rank = np.empty(len(ranked), np.int64)
    rank[ranked.to_numpy()] = np.arange(len(ranked))
    return sent, clusters.dictionary.take(ranked), rank[clusters.indices.to_numpy()]


def _best_moves(sent: DataFrame, graph: DataFrame, m: float) -> DataFrame:
    """(node, to, from, k, gain): a giver's node and the taker next to it of the greatest gain, ties to the least name."""
    name = sent.schema["nodes"].dataType.elementType
    schema = T.StructType([*[T.StructField(c, name) for c in ("node", "to", "from")], T.StructField("k", T.DoubleType()), T.StructField("gain", T.DoubleType())])

    def run(key, sent, graph):
        sent, named, code = _ranked(sent)
        nodes, k = sent.column("nodes")[0].values, _numbers(sent, "k", 0, np.float64)
        total, gives = np.empty(len(named)), np.empty(len(named), bool)
        for column, of, kind in (("all", total, np.float64), ("gives", gives, bool)):
            of[code] = np.concatenate([_numbers(sent, column, at, kind) for at in range(sent.num_rows)])
        own, halo = code[: len(nodes)], code[len(nodes) :]
        pos, j, w = (_numbers(graph, c, 0, t) if graph.num_rows else np.empty(0, t) for c, t in (("pos", np.int32), ("j", np.int32), ("w", np.float64)))
        to = halo[j]
        use = gives[own[pos]] & (~gives[to] | (to == own[pos]))
        link, which = np.unique(pos[use] * np.int64(len(named)) + to[use], return_inverse=True)
        weight = np.bincount(which, w[use], len(link))
        node, to = np.divmod(link, max(len(named), 1))
        stays = to == own[node]
        inner = np.zeros(len(nodes))
        inner[node[stays]] = weight[stays]
        node, to, weight = node[~stays], to[~stays], weight[~stays]
        rest = total[own[node]] - k[node]
        gain = (weight - inner[node]) / m - k[node] * (total[to] - rest) / (2 * m * m)
        order = np.lexsort((to, -gain, node))
        node, to, gain = node[order], to[order], gain[order]
        best = np.append(True, node[1:] != node[:-1])[: len(node)] & (gain > 1e-15)
        node, to, gain = node[best], to[best], gain[best]
        return pa.Table.from_arrays([nodes.take(pa.array(node)), named.take(pa.array(to)), named.take(pa.array(own[node])), pa.array(k[node]), pa.array(gain)], schema.names)

    return sent.groupBy("part").cogroup(graph.select("part", "pos", "j", "w").groupBy("part")).applyInArrow(run, schema)


def _between(near: Packed, state: DataFrame) -> DataFrame:
    """(a, b, w): the clusters that the packed edges join, a <= b, with a sum a part: edges are not joined with names."""
    placed = state.select("part", "pos", "node", "cluster", "k", F.lit(0.0).alias("all"), F.lit(False).alias("gives"))
    name = state.schema["cluster"].dataType
    schema = T.StructType([T.StructField("a", name), T.StructField("b", name), T.StructField("w", T.DoubleType())])

    def run(key, sent, graph):
        sent, named, code = _ranked(sent)
        n = len(sent.column("nodes")[0].values)
        pos, j, w, halo = (_numbers(graph, c, 0, t) if graph.num_rows else np.empty(0, t) for c, t in (("pos", np.int32), ("j", np.int32), ("w", np.float64), ("halo", np.int64)))
        once = (np.int64(key[0].as_py()) << 32 | pos.astype(np.int64)) < halo[j]  # the other end has the edge too
        x, y = code[pos[once]], code[n + j[once]]
        pair, which = np.unique(np.minimum(x, y) * np.int64(len(named)) + np.maximum(x, y), return_inverse=True)
        a, b = np.divmod(pair, max(len(named), 1))
        return pa.Table.from_arrays([named.take(pa.array(a)), named.take(pa.array(b)), pa.array(np.bincount(which, w[once], len(pair)))], schema.names)

    return _sent(placed, near.sends).groupBy("part").cogroup(near.graph.groupBy("part")).applyInArrow(run, schema)


def _tried(moves: DataFrame, end: str) -> DataFrame:
    """``moves`` with ``before_<end>``: the degrees of the moves at the cluster ``end`` that are tried before, or in the same place."""
    sums = moves.groupBy(end, "step", "part").agg(F.sum("k").alias("s"))
    past = F.sum("s").over(Window.partitionBy(end).orderBy(F.desc("step"), "part"))
    return moves.join(sums.select(end, "step", "part", past.alias(f"before_{end}")), [end, "step", "part"]).withColumn(f"before_{end}", F.col(f"before_{end}") - F.col("k"))


def _round(near: DataFrame | Packed, state: DataFrame, m: float, at: int, seed: int) -> DataFrame:
    """(node, to, sure): the moves of a round, with gains in modularity that are sure; of (node, other, w) both ways, or of what was made of it with ``state`` in its places."""
    if isinstance(near, DataFrame):
        near = _packed(near.where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"), "w"), state)
        state = state.join(near.places, "node")
    gives = F.pmod(F.xxhash64("cluster", F.lit(seed), F.lit(at // 2)), F.lit(2)) == at % 2
    total = state.groupBy("cluster").agg(F.sum("k").alias("all"))
    placed = state.join(total, "cluster").select("part", "pos", "node", "cluster", "k", "all", gives.alias("gives"))
    moves = _best_moves(_sent(placed, near.sends), near.graph, m)
    moves = moves.withColumn("step", F.least(F.lit(STEPS), F.greatest(F.lit(0), STEPS + F.floor(4 * F.log2(F.col("gain") * m / F.col("k"))))).cast("int"))
    moves = stage(moves.withColumn("part", F.pmod(F.xxhash64("node", F.lit(at)), F.lit(PARTS)).cast("int")), "moves")
    sure = F.col("gain") - F.col("k") * (F.col("before_from") + F.col("before_to")) / (2 * m * m)
    return _tried(_tried(moves, "from"), "to").select("node", "to", sure.alias("sure")).where("sure > 0")


def louvain_levels(edges: DataFrame, least_gain: float = 1e-6, most_rounds: int = 40, most_levels: int = 12, seed: int = 1) -> DataFrame:
    """(level, node, cluster): the communities of every level from 1 on; modularity rises from level to level.

    Of (src, dst, weight): undirected, parallel weights are summed, self-loops
    count to their node's cluster; edges with a null end or a weight that is
    not positive go. A level ends after four rounds without a gain of
    ``least_gain`` in modularity or after ``most_rounds``; its clusters are the
    nodes of the next. An empty graph gives an empty result. A cluster is named
    by one of its nodes. Every round is written.
    """
    pair = edges.where("src IS NOT NULL AND dst IS NOT NULL AND weight > 0").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
    pairs = stage(pair, "louvain")
    m = pairs.agg(F.sum("w")).first()[0]
    whole = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster", F.col("node")), "members")
    levels = whole.where("false").select(F.lit(0).alias("level"), "node", "cluster")
    for level in range(1, most_levels + 1 if m else 0):
        state = stage(pairs.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k")).withColumn("cluster", F.col("node")), "state")
        near = _packed(pairs.where("a <> b"), state)
        state = stage(state.join(near.places, "node"), "state")
        idle, moved = 0, False
        for at in range(most_rounds):
            moves = stage(_round(near, state, m, at, seed * 100 + level), "moved")
            sure = moves.agg(F.sum("sure")).first()[0] or 0.0
            if sure > 0:
                moved = True
                state = stage(state.join(moves.select("node", "to"), "node", "left").select("node", "k", F.coalesce("to", "cluster").alias("cluster"), "part", "pos"), "state")
            idle = 0 if sure > least_gain else idle + 1
            if idle == 4:
                break
        if not moved:
            break
        to = state.select(F.col("node").alias("cluster"), F.col("cluster").alias("to"))
        whole = stage(whole.join(to, "cluster").select("node", F.col("to").alias("cluster")), "members")
        levels = levels.unionByName(whole.select(F.lit(level).alias("level"), "node", "cluster"))
        loops = pairs.where("a = b").join(to.select(F.col("cluster").alias("a"), "to"), "a").select(F.col("to").alias("a"), F.col("to").alias("b"), "w")
        pairs = stage(_between(near, state).unionByName(loops).groupBy("a", "b").agg(F.sum("w").alias("w")), "louvain")
    return levels if m else whole.select(F.lit(0).alias("level"), "node", "cluster").where("false")


def louvain(edges: DataFrame, **how) -> DataFrame:
    """(node, cluster): the communities of the last level; without any gain each node is its own."""
    levels = louvain_levels(edges, **how)
    last = levels.agg(F.max("level")).first()[0]
    if last is None:
        nodes = edges.where("src IS NOT NULL AND dst IS NOT NULL AND weight > 0").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        return nodes.withColumn("cluster", F.col("node"))
    return levels.where(F.col("level") == last).select("node", "cluster")
