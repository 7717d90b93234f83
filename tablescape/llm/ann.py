"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

A shard's graph is flat arrays: the vectors, and for every layer a matrix of
neighbour numbers. Layers are built from the top; a layer takes its nodes in
batches that double, each batch searched and linked at once with numpy (the
published way to build such graphs in parallel). Searches of many queries walk
the graph in lock step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.llm.common import arrow_map, arrow_schema
from tablescape.session import stage

#: Vectors in a shard, about: the graph that one task builds.
SHARD = 16384
#: Queries that walk a shard's graph together.
QUERY_TILE = 1024
#: Neighbours of a node in the upper layers; the lowest has twice as many.
LINKS = 16
#: Nodes that a walk keeps while it builds, and while it answers: what recall hangs on. Vectors of very different lengths need more (three times as many in the tests).
BUILD_WIDTH, SEARCH_WIDTH = 96, 256
#: Nodes inserted at once, at most; nodes whose links go on in one step of a walk.
BATCH, AHEAD = 512, 4
#: Lists that meet in one node of the merging tree.
FAN_IN = 16


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors scaled and with one more component that makes all of one length: then the nearest by distance is the one of the largest inner product.

    In doubles: in single precision near copies cannot be told apart.
    """
    scale = float(np.abs(x).max(initial=0)) or 1.0
    y = x / scale
    norm = (y * y).sum(1)
    return np.concatenate([y, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], 1)


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int, ahead: int = AHEAD) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, products), best first: the ``width`` best nodes that each query's walk from ``start`` meets; a row that has fewer ends in -1.

    ``links`` is a row of neighbours a node, -1 where it has fewer. In each step
    a query goes on from its ``ahead`` best nodes that it has not gone on from.
    """
    n, m = len(q), len(x)
    seen = np.zeros((n, m + 1), bool)
    seen[:, m] = True  # what -1 stands for
    ids, best, done = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf), np.zeros((n, width), bool)
    ids[:, 0], best[:, 0] = start, np.einsum("ij,ij->i", x[start], q)
    seen[np.arange(n), start] = True
    active = np.arange(n)
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), -np.inf, best[active])
        pick = np.argpartition(-open_, ahead - 1, 1)[:, :ahead] if ahead < width else np.argsort(-open_, 1)[:, :ahead]
        live = np.take_along_axis(open_, pick, 1) > -np.inf
        keep = live.any(1)
        active, pick, live = active[keep], pick[keep], live[keep]
        if not len(active):
            break
        rows = active[:, None]
        done[rows, pick] = True
        near = np.where(live[:, :, None], links[ids[rows, pick]], -1).reshape(len(active), -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[rows, near]] = -1
        seen[rows, near] = True
        product = np.matmul(x[near], q[active][:, :, None])[:, :, 0]
        product[near < 0] = -np.inf
        product = np.concatenate([best[active], product], 1)
        top = np.argpartition(-product, width - 1, 1)[:, :width]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), top, 1)
        best[active] = np.take_along_axis(product, top, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(near.shape, bool)], 1), top, 1)
        ids[active] = np.where(best[active] > -np.inf, ids[active], -1)
    order = np.lexsort((ids, -best), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)


def spread(x: np.ndarray, node: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, up to ``most`` that are nearer to the node than to one taken before; the best of the rest fill it up. -1: none."""
    there = near >= 0
    own = np.where(there, np.matmul(x[near], x[node][:, :, None])[:, :, 0], -np.inf)
    order = np.lexsort((near, -own), axis=1)
    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    among = np.matmul(x[near], x[near].transpose(0, 2, 1))
    closest, taken, count = np.full(near.shape, -np.inf), np.zeros(near.shape, bool), np.zeros(len(near), int)
    for j in range(near.shape[1]):
        ok = (near[:, j] >= 0) & (count < most) & (own[:, j] > closest[:, j])
        taken[:, j] = ok
        count += ok
        np.maximum(closest, np.where(ok[:, None], among[:, j], -np.inf), out=closest)
    first = np.argsort(~taken * 2 + (near < 0), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, first, 1)


def join_links(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Give the neighbours of the ``new`` nodes a link back; a node of too many keeps those that ``spread`` takes."""
    most = links.shape[1]
    src, dst = np.repeat(new, most), links[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.lexsort((-np.einsum("ij,ij->i", x[src], x[dst]), dst))  # the nearest newcomers first
    src, dst = src[order], dst[order]
    node, first, n = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(first, n)
    src, row, place = src[place < most], np.repeat(np.arange(len(node)), n)[place < most], place[place < most]
    came = np.full((len(node), min(int(n.max(initial=0)), most)), -1, links.dtype)
    came[row, place] = src
    for at in range(0, len(node), BATCH):
        part = slice(at, at + BATCH)
        all_ = np.sort(np.concatenate([links[node[part]], came[part]], 1), 1)
        all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
        full = (all_ >= 0).sum(1) > most
        kept = -np.sort(-all_, 1)[:, :most]
        if full.any():
            kept[full] = spread(x, node[part][full], all_[full], most)
        links[node[part]] = kept


def levels_of(n: int, links: int, seed: int = 7) -> np.ndarray:
    """How many layers above the lowest each node is in: geometric, as 1/ln(links) has it."""
    return np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(np.int32)


def build(x: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> list[tuple[int, np.ndarray]]:
    """The graph over ``x``, whose rows are in their order of insertion: a layer's (nodes, neighbours), from the top; the nodes are the first rows."""
    n = len(x)
    if not n:
        return []
    level = np.sort(levels_of(n, links))[::-1]
    layers: list[tuple[int, np.ndarray]] = []
    for depth in range(int(level[0]), -1, -1):
        size, most = int((level >= depth).sum()), links * (1 + (depth == 0))
        near = np.full((size, most), -1, np.int32)
        have = 1
        while have < size:
            new = np.arange(have, min(size, have + min(max(have, 32), BATCH)))
            found, _ = walk(x[:have], near[:have], x[new], entry(x, [la for la in layers if la[0] <= have], x[new]), width)
            # members of the batch may be one another's nearest
            product = x[new] @ x[new].T
            np.fill_diagonal(product, -np.inf)
            same = np.argsort(-product, 1)[:, : min(most, len(new) - 1)]
            near[new] = spread(x, new, np.concatenate([found[:, : max(width // 2, most)], new[same]], 1).astype(np.int32), most)
            join_links(x, near, new)
            have = int(new[-1]) + 1
        layers.append((size, near))
    return layers


def entry(x: np.ndarray, layers: list[tuple[int, np.ndarray]], q: np.ndarray) -> np.ndarray:
    """The node each query comes to by walking down ``layers``, one node wide."""
    at = np.zeros(len(q), np.int64)
    for size, near in layers:
        at = walk(x[:size], near, q, at, 1, 1)[0][:, 0]
    return at


def found_by(x: np.ndarray, layers: list[tuple[int, np.ndarray]], q: np.ndarray, width: int) -> np.ndarray:
    """The up to ``width`` best nodes of each query, best first, -1 for none."""
    return walk(x, layers[-1][1], q, entry(x, layers[:-1], q), width)[0]


INDEX = "dim int, shards int, shard int, vectors binary, ids array<bigint>, counts array<int>, classes array<int>, sizes array<int>, links binary"
INDEX_ARRAYS = ("vectors", "ids", "counts", "classes", "sizes", "links")


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x, dim, n): rows with an id and a vector of finite components that are not all zero, equal rows once with their number."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).where(
        F.expr("vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(x, v -> v <> 0)")
    )
    return rows.groupBy("vec_id", "x").agg(F.count("*").cast("int").alias("n")).withColumn("dim", F.size("x"))


def _order(x: np.ndarray) -> np.ndarray:
    """A fixed order that has nothing to do with the vectors' places: by the bytes' digests."""
    import xxhash

    return np.argsort(np.array([xxhash.xxh64_intdigest(r.tobytes(), 7) for r in x], np.uint64), kind="stable")


def index_of(ids: np.ndarray, counts: np.ndarray, x: np.ndarray, links: int, width: int) -> dict:
    """The flat arrays of a shard. Equal vectors are one node, a class of ids in ascending order, so copies cost no link."""
    node, inverse = np.unique(x + 0.0, axis=0, return_inverse=True)
    order = _order(node)
    node, place = node[order], np.argsort(order)[inverse.ravel()]
    at = np.lexsort((ids, place))
    layers = build(lifted(node), links, width)
    return {
        "vectors": node.astype("<f8").tobytes(), "ids": ids[at], "counts": counts[at], "classes": np.searchsorted(place[at], np.arange(len(node) + 1)).astype(np.int32),
        "sizes": np.array([s for s, _ in layers], np.int32), "links": b"".join(near.astype("<i4").tobytes() for _, near in layers),
    }


def graph_index(vectors: DataFrame, shard: int = SHARD, links: int = LINKS, width: int = BUILD_WIDTH, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The index as a written table, a row a shard: every usable row is in it.

    Vectors of one length are dealt to shards by a hash of id and vector, so
    hot vectors spread; a task builds a shard's graph. Rows that are null,
    zero, or hold null or non-finite components, and those without an id, are
    left out; an empty table gives an empty index.
    """
    rows = stage(usable(vectors, vec_id, embedding), "vectors")
    counts = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = rows.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "x"), F.col("shards")).cast("int"))
    wanted = arrow_schema(INDEX)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dim, shards, own = (group[c][0].as_py() for c in ("dim", "shards", "shard"))
        x = pa.concat_arrays(group["x"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        made = index_of(group["vec_id"].to_numpy(), group["n"].to_numpy(), x, links, width)
        return pa.Table.from_pydict({k: [v] for k, v in {"dim": dim, "shards": shards, "shard": own, **made}.items()}, schema=wanted)

    return stage(dealt.select("dim", "shards", "shard", "vec_id", "n", "x").groupBy("dim", "shard").applyInArrow(run, INDEX), "graphs")


class Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict, links: int):
        self.ids, self.counts, self.classes = (np.asarray(row[c]) for c in ("ids", "counts", "classes"))
        self.x = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
        flat, at, self.layers = np.frombuffer(row["links"], "<i4"), 0, []
        for depth, size in enumerate(row["sizes"]):
            most = links * (1 + (depth == len(row["sizes"]) - 1))
            self.layers.append((size, flat[at : at + size * most].reshape(size, most)))
            at += size * most
        self.lifted = lifted(self.x)

    def entries(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k ids of every class, each as often as it stands, in a row a class; and which cells are filled."""
        n = np.minimum(self.counts, k)
        ids, owner = np.repeat(self.ids, n), np.repeat(np.repeat(np.arange(len(self.x)), np.diff(self.classes)), n)
        place = np.arange(len(ids)) - np.searchsorted(owner, owner)
        there = np.zeros((len(self.x), min(k, int(place.max(initial=0)) + 1)), bool)
        table, in_ = np.zeros(there.shape, np.int64), place < there.shape[1]
        there[owner[in_], place[in_]], table[owner[in_], place[in_]] = True, ids[in_]
        return table, there

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, product in doubles): each query's k best of what the walk finds, ties to the smaller id; its own id is no candidate."""
        q_unit = q / np.maximum(np.abs(q).max(1, keepdims=True, initial=0), np.finfo(float).tiny)
        found = found_by(self.lifted, self.layers, np.concatenate([q_unit, np.zeros((len(q), 1))], 1), max(2 * (k + 1), width))
        (table, there), least, out = self.entries(k + 1), self.ids[self.classes[:-1]], []
        for at in range(0, len(q), 128):
            f = found[at : at + 128]
            score = products(q[at : at + 128], self.x[f])
            order = np.lexsort((least[f], -score, f < 0), axis=1)[:, : k + 1]  # every class has an id, so no more are needed
            f, score = np.take_along_axis(f, order, 1), np.take_along_axis(score, order, 1)
            c = table[f].reshape(len(f), -1)
            out_of = ~(there[f] & (f >= 0)[:, :, None]).reshape(len(f), -1) | (c == q_ids[at : at + 128, None])
            s = np.repeat(score, table.shape[1], 1)
            order = np.lexsort((c, -s, out_of), axis=1)[:, :k]
            row, col = np.nonzero(~np.take_along_axis(out_of, order, 1))
            out.append((row + at, np.take_along_axis(c, order, 1)[row, col], np.take_along_axis(s, order, 1)[row, col]))
        return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in doubles of each row of ``q`` with its rows of ``x``, summed from the first component on, so that equal vectors have equal products."""
    out = np.zeros(x.shape[:2])
    for j in range(q.shape[1]):
        out += q[:, None, j] * x[:, :, j]
    return out


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, links: int = LINKS, width: int = SEARCH_WIDTH, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` the k nearest that the walks find, by largest inner product in doubles of the original vectors.

    ``links`` is that of the index. Ties go to the smaller vec_id; a query
    never meets its own id; a repeated row is a candidate as often as it
    stands, a repeated query is asked once. Queries without an id, null, zero,
    or with null or non-finite components have no rows; a query meets vectors
    of its own length. With at most ``width`` vectors in each shard the walk
    reaches whatever its links reach; recall is measured in the tests.

    Tiles of queries meet shards in blocks; a block gives k rows a query at
    most, merged in a tree of ``FAN_IN`` lists a node.
    """
    asked = usable(queries, vec_id, embedding).withColumn("q_hash", F.xxhash64("x"))
    tiles = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_TILE).alias("tiles"))
    tiles = asked.join(tiles, "dim").groupBy("dim", F.pmod(F.xxhash64("vec_id", "q_hash"), "tiles").alias("tile")).agg(F.collect_list(F.struct("vec_id", "q_hash", "x")).alias("rows"))
    tiles = stage(tiles.select("dim", F.col("rows.vec_id").alias("q_ids"), F.col("rows.q_hash").alias("q_hash"), F.flatten("rows.x").alias("q_xs")), "queries")
    wide = index.groupBy("dim").agg(F.max("shards").alias("shards"))
    left = tiles.join(wide, "dim").select("dim", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), "q_ids", "q_hash", "q_xs")
    pairs = left.join(index.drop("shards"), ["dim", "shard"]).select("shard", "q_ids", "q_hash", "q_xs", "dim", *INDEX_ARRAYS)

    def make(batch: pa.RecordBatch) -> dict:
        parts = []
        for i in range(batch.num_rows):
            q_ids, q_hash, q = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in (1, 2, 3))
            row = {"dim": batch.column(4)[i].as_py()} | {c: batch.column(5 + j)[i].as_py() if pa.types.is_binary(batch.column(5 + j).type) else batch.column(5 + j)[i].values.to_numpy() for j, c in enumerate(INDEX_ARRAYS)}
            of, ids, score = Shard(row, links).nearest(q_ids, q.reshape(len(q_ids), -1), k, width)
            parts.append((q_ids, q_hash, np.full(len(q_ids), batch.column(0)[i].as_py()), np.bincount(of, minlength=len(q_ids)), ids, score))
        q_ids, q_hash, node, sizes, ids, score = (np.concatenate([p[j] for p in parts]) for j in range(6))
        entries = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids)], ["neg", "vec_id"])
        return {"query_id": pa.array(q_ids), "q_hash": pa.array(q_hash), "node": pa.array(node, pa.int64()), "best": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), entries)}

    best = arrow_map(pairs, make, "query_id bigint, q_hash bigint, node bigint, best array<struct<neg: double, vec_id: bigint>>", most_bytes=32 << 20)
    nodes = wide.agg(F.max("shards")).first()[0] or 1
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        best = best.groupBy("query_id", "q_hash", F.expr(f"node div {FAN_IN}").alias("node")).agg(F.flatten(F.collect_list("best")).alias("best")).withColumn("best", F.slice(F.array_sort("best"), 1, k))
    ranked = best.select("query_id", F.posexplode(F.slice(F.array_sort("best"), 1, k)).alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score"))


def op12_nearest(vectors: DataFrame) -> DataFrame:
    """The contract's columns: every row is indexed, rows whose vec_id is divisible by 20 are the queries, 20 nearest each."""
    return nearest(graph_index(vectors), vectors.where(F.col("vec_id") % 20 == 0), 20)
