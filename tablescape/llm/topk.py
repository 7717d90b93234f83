"""Exact top-k inner-product search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.llm.common import arrow_map
from tablescape.session import stage

#: Vectors in a query tile and in a candidate shard.
QUERY_TILE, SHARD = 512, 4096
#: Lists that meet in one node of the merging tree.
FAN_IN = 16


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, is_query, dim, x): rows with an id and a vector of finite components, as integers floor(scale * component)."""
    ok = F.expr("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(cast(x as double)) < double('Infinity'))")
    return vectors.where(ok).select(F.col("vec_id").cast("bigint").alias("vec_id"), "is_query", F.size("embedding").alias("dim"), F.expr(f"transform(embedding, x -> floor({scale}D * cast(x as double)))").alias("x"))


def _tiles(rows: DataFrame, per: int) -> DataFrame:
    """(dim, tiles, tile, ids, xs): vectors packed into tiles of about ``per``, dealt by a hash so that equal vectors spread too."""
    counts = rows.groupBy("dim").agg(F.ceil(F.count("*") / per).alias("tiles"))
    return (
        rows.join(counts, "dim")
        .withColumn("tile", F.pmod(F.xxhash64("vec_id", "x"), F.col("tiles")).cast("int"))
        .groupBy("dim", "tiles", "tile")
        .agg(F.collect_list(F.struct("vec_id", "x")).alias("rows"))
        .select("dim", "tiles", "tile", F.col("rows.vec_id").alias("ids"), F.flatten("rows.x").alias("xs"))
    )


def best_of(q_ids, q, c_ids, c, k):
    """(query row, candidate id, score) of each query's k best: higher score first, then smaller id; no query meets its own id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        scores = q.astype(np.float64) @ c.astype(np.float64).T
    elif most < 2**63:
        scores = q @ c.T
    else:  # exact in Python integers, held to the range of a long
        scores = np.clip(q.astype(object) @ c.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        allowed = np.flatnonzero(c_ids != q_ids[i])
        s = scores[i][allowed]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            above, at = np.flatnonzero(s > edge), np.flatnonzero(s == edge)  # ascending id among ties
            pick = np.concatenate([above, at[: k - len(above)]])
        else:
            pick = np.arange(len(s))
        out_q.append(np.full(len(pick), i))
        out_c.append(c_ids[allowed[pick]])
        out_s.append(s[pick].astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def exact_top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds for, the k highest integer inner products over all other rows.

    Components become floor(scale * component). Ties go to the smaller vec_id;
    a query never meets rows of its own id. Vectors that are null or hold null
    or non-finite components, and rows without an id, take no part; vectors
    meet vectors of their own length; a repeated row is a candidate as often as
    it stands. Products are exact; beyond the range of a long they are held to
    its ends. Empty tables give an empty result.

    Query tiles meet candidate shards in blocks (a stated query set against
    all rows); each pair gives k rows a query at most, merged in a tree of
    ``FAN_IN`` lists a node.
    """
    rows = stage(usable(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query")), scale), "vectors")
    queries = stage(_tiles(rows.where("is_query").drop("is_query").dropDuplicates(["vec_id", "x"]), QUERY_TILE), "queries")
    shards = stage(_tiles(rows.drop("is_query"), SHARD), "shards")
    # every query tile goes to every shard of its dimension: the copies are keyed, so the join is an equi-join of blocks
    wide = shards.groupBy("dim").agg(F.max("tiles").alias("shards"))
    left = queries.join(wide, "dim").select("dim", F.explode(F.expr("sequence(0, cast(shards as int) - 1)")).alias("tile"), F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"))
    pairs = left.join(shards.select("dim", "tile", "ids", "xs"), ["dim", "tile"]).select("dim", "tile", "q_ids", "q_xs", "ids", "xs")

    def make(batch):
        dims, tiles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        parts = []
        for i, (dim, tile) in enumerate(zip(dims, tiles)):
            q_ids, q, c_ids, c = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(2, 6))
            q, c = q.reshape(len(q_ids), dim), c.reshape(len(c_ids), dim)
            row, ids, score = best_of(q_ids, q, c_ids, c, k)
            parts.append((q_ids, _hash_rows(q), np.full(len(q_ids), tile), np.bincount(row, minlength=len(q_ids)), ids, score))
        q_ids, q_hash, node, sizes, ids, score = (np.concatenate([p[j] for p in parts]) for j in range(6))
        entries = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids)], ["neg", "vec_id"])
        return {"query_id": pa.array(q_ids), "q_hash": pa.array(q_hash), "node": pa.array(node, pa.int64()), "best": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), entries)}

    best = arrow_map(pairs, make, "query_id bigint, q_hash bigint, node bigint, best array<struct<neg: bigint, vec_id: bigint>>", most_bytes=16 << 20)
    nodes = wide.agg(F.max("shards")).first()[0] or 1
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        best = best.groupBy("query_id", "q_hash", F.expr(f"node div {FAN_IN}").alias("node")).agg(F.flatten(F.collect_list("best")).alias("best")).withColumn("best", F.slice(F.array_sort("best"), 1, k))
    ranked = best.withColumn("best", F.slice(F.array_sort("best"), 1, k)).select("query_id", F.posexplode("best").alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score"))


def _hash_rows(x: np.ndarray) -> np.ndarray:
    """A number for each row of integers, equal for equal rows; tells apart different vectors under one query id."""
    with np.errstate(over="ignore"):
        out = np.full(len(x), 1469598103934665603, np.uint64)
        for col in x.astype(np.int64).view(np.uint64).reshape(x.shape).T:
            out = (out ^ col) * np.uint64(1099511628211)
    return out.view(np.int64)


def op5_top_k(vectors: DataFrame) -> DataFrame:
    return exact_top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64.0)
