"""Spectral clustering: the least eigenvectors of the normalised Laplacian by block power iteration on the edges, and k-means over the nodes' rows.

The iteration keeps all blocks it has made (a block Krylov space) orthonormal.
Nodes lie in parts by ranges of their names; a block is a table of panels, a
row a part with the entries of its nodes, written once in buckets by part, so
blocks meet without a shuffle, in rows of one panel each: no row holds more. The graph is packed once, a row for each two
parts that edges join. A step multiplies the last block by it and shuffles one
sum for each node and each part that it has neighbours in; what is dense by
nodes (inner products, combinations of columns) runs with numpy over a task's
panels and gives matrices of the number of columns, which the driver solves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tablescape.session import Buckets, merged, stage, stage_buckets

#: Columns in a block beyond those asked for; blocks before a restart; norm of a residual that ends it.
SPARE, BLOCKS, TOLERANCE = 3, 12, 1e-5
#: Nodes in a part, more where there would be more than so many parts.
PART, MOST_PARTS = 32_768, 200
_PANEL = "part int, n int, x binary"


def _list(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row that is the list of all of ``x``."""
    return pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _bytes(x: np.ndarray) -> pa.Array:
    """One row that is the bytes of ``x``."""
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _values(table: pa.Table, name: str, at: int) -> np.ndarray:
    return table.column(name)[at].values.to_numpy(zero_copy_only=False)


def _panel(table: pa.Table, at: int) -> np.ndarray:
    """The entries in row ``at``, a row a node."""
    return np.frombuffer(table.column("x")[at].as_buffer(), np.float64).reshape(table.column("n")[at].as_py(), -1)


def _beside(groups: dict[str, list[DataFrame]]) -> tuple[DataFrame, dict[str, list[str]]]:
    """(part, n, a column a block): the blocks of all groups, and the columns of each group. For few blocks: a row holds a part's panels of all."""
    out, names = None, {}
    for g, blocks in groups.items():
        names[g] = [f"{g}_{i}" for i in range(len(blocks))]
        for c, block in zip(names[g], blocks):
            out = block.select("part", "n", F.col("x").alias(c)) if out is None else out.join(block.select("part", F.col("x").alias(c)), "part")
    return out, names


def _matrices(panels: pa.Table, groups: dict[str, list[int]]) -> dict[str, np.ndarray]:
    """The columns of each group, of the panels of a part."""
    at = {number: i for i, number in enumerate(panels.column("piece").to_pylist())}
    return {g: np.hstack([_panel(panels, at[number]) for number in numbers]) for g, numbers in groups.items()}


def _row(part: int, x: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array([part], pa.int32()), pa.array([len(x)], pa.int32()), _bytes(x)], ["part", "n", "x"])


def _products(f, space: Buckets, **groups: list[int]) -> list[np.ndarray]:
    """The sum over all parts of each matrix that ``f`` makes of a part's groups of blocks; a part gives one row a matrix, and those are summed."""
    def run(panels):
        made = f(**_matrices(panels, groups))
        return pa.Table.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array([t.shape[1] for t in made], pa.int32()), pa.array([t.ravel().tolist() for t in made], pa.list_(pa.float64()))], ["pair", "width", "m"])

    made = space.read(*sum(groups.values(), [])).groupBy("part").applyInArrow(run, "pair int, width int, m array<double>")
    cells = made.select("pair", "width", F.posexplode("m").alias("i", "v")).groupBy("pair", "width", "i").agg(F.sum("v").alias("v"))
    found: dict[int, list] = {}
    for r in cells.collect():  # squares of the number of columns
        found.setdefault(r["pair"], []).append(r)
    return [np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])]).reshape(-1, rows[0]["width"]) for _, rows in sorted(found.items())]


def _combined(f, space: Buckets, **groups: list[int]) -> int:
    """The block that ``f`` makes of a part's groups of blocks."""
    run = lambda panels: _row(panels.column("part")[0].as_py(), f(**_matrices(panels, groups)))
    return space.add(space.read(*sum(groups.values(), [])).groupBy("part").applyInArrow(run, _PANEL))


def _orthonormal(gram: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """R such that X R has orthonormal columns, for X'X = gram; directions that are as good as dependent go."""
    value, vector = np.linalg.eigh(gram)
    keep = value > least * max(value.max(initial=0), 1e-300)
    return vector[:, keep] / np.sqrt(value[keep])


def _packed(pairs: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    """The normalised matrix of (a, b, weight): a row for each two parts with edges, (part, to, size, ids, starts, j, w).

    ``ids`` are the places in the part ``to``, of ``size`` nodes, that have
    neighbours in ``part``; those of the one at ``at`` are ``j[starts[at]:starts[at + 1]]``.
    """
    end = lambda c: places.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}"), F.col("pos").alias(f"pos_{c}"), F.col("n").alias(f"n_{c}"), F.sqrt("d").alias(f"root_{c}"))
    e = merged(pairs, end("a"), "a").select("b", "part_a", "pos_a", "n_a", (F.col("weight") / F.col("root_a")).alias("w"))
    e = merged(e, end("b"), "b").select("part_a", "part_b", "pos_a", "pos_b", "n_a", "n_b", (F.col("w") / F.col("root_b")).alias("w"))
    schema = "part int, to int, size int, ids array<int>, starts array<int>, j array<int>, w array<double>"
    ints = [("part", pa.int32()), ("to", pa.int32()), ("size", pa.int32())]

    def row(part, to, size, i, j, w):
        order = np.lexsort((j, i))
        ids, starts = np.unique(i[order], return_index=True)
        lists = [_list(ids, pa.int32()), _list(starts, pa.int32()), _list(j[order], pa.int32()), _list(w[order], pa.float64())]
        return pa.Table.from_arrays([*(pa.array([v], t) for v, (_, t) in zip((part, to, size), ints)), *lists], [*(n for n, _ in ints), "ids", "starts", "j", "w"])

    def pack(key, edges):
        a, b = (k.as_py() for k in key)
        i, j, w = (edges.column(c).to_numpy() for c in ("pos_a", "pos_b", "w"))
        n_a, n_b = edges.column("n_a")[0].as_py(), edges.column("n_b")[0].as_py()
        if a == b:
            return row(a, a, n_a, np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w]))
        return pa.concat_tables([row(b, a, n_a, i, j, w), row(a, b, n_b, j, i, w)])

    return stage_buckets(e.groupBy("part_a", "part_b").applyInArrow(pack, schema), "spectral-matrix", "part", buckets)


def _multiplied(matrix: DataFrame, block: int, width: int, space: Buckets) -> int:
    """The graph times ``block``."""
    names = ["part", "n", "ids", "x"]

    def run(rows, block):
        made = []
        for at in range(rows.num_rows):
            ids, starts, j, w = (_values(rows, c, at) for c in ("ids", "starts", "j", "w"))
            x = _panel(block, 0)
            made.append(_bytes(np.stack([np.add.reduceat(w * x[j, c], starts) for c in range(width)], axis=1)))
        return pa.Table.from_arrays([rows.column("to"), rows.column("size"), rows.column("ids"), pa.chunked_array(made, pa.binary())], names)

    def total(group):
        y = np.zeros((group.column("n")[0].as_py(), width))
        for at in range(group.num_rows):
            y[_values(group, "ids", at)] += np.frombuffer(group.column("x")[at].as_buffer(), np.float64).reshape(-1, width)
        return _row(group.column("part")[0].as_py(), y)

    # a panel is read once for all rows of its part
    parts = matrix.groupBy("part").cogroup(space.read(block).groupBy("part")).applyInArrow(run, "part int, n int, ids array<int>, x binary")
    return space.add(parts.groupBy("part").applyInArrow(total, _PANEL))


def spectral_embedding(edges: DataFrame, k: int, spare: int = SPARE, blocks: int = BLOCKS, tolerance: float = TOLERANCE, most_restarts: int = 20, seed: int = 1, part: int = PART) -> tuple[DataFrame, list[float]]:
    """(node, u) and the ``k`` least eigenvalues of the normalised Laplacian I - D^-1/2 W D^-1/2, ascending; ``u`` has the node's entries of their eigenvectors.

    Of (src, dst, weight): undirected, the greatest weight of parallels,
    self-loops and weights that are not positive go. With fewer nodes than
    ``k`` there are as many as nodes; an empty graph gives none. A residual of
    norm r leaves an eigenvalue within r of the true one, and within r squared
    over its gap.
    """
    pairs = edges.where("weight > 0").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight")).where("a <> b")
    pairs = stage(pairs, "spectral-edges")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "weight")
    degree = stage(ends.groupBy("node").agg(F.sum("weight").alias("d")), "spectral-degrees")
    n = degree.count()
    empty = edges.sparkSession.createDataFrame([], T.StructType([degree.schema["node"], T.StructField("u", T.ArrayType(T.DoubleType()))]))
    if not n:
        return empty, []
    buckets = min(MOST_PARTS, math.ceil(n / part))
    # where names and neighbours go together, a node's neighbours lie in few parts
    ranged = stage(degree.repartitionByRange(buckets, "node").select("*", F.spark_partition_id().alias("part")), "spectral-ranges")
    place = Window.partitionBy("part")
    places = stage(ranged.select("*", (F.row_number().over(place.orderBy("node")) - 1).alias("pos"), F.count("*").over(place).cast("int").alias("n")), "spectral-places")
    w, k = _packed(pairs, places, buckets), min(k, n)
    width = min(k + spare, n)
    noise = [F.xxhash64("node", F.lit(seed * 1000 + i)).cast("double") / 2.0**63 for i in range(1, width)]
    # the first column is the eigenvector of a connected graph
    columns = {f"x{i}": c for i, c in enumerate([F.sqrt("d"), *noise])}
    names = [*columns]

    def first(nodes):
        nodes = nodes.sort_by("pos").combine_chunks()
        named = nodes.column("node").combine_chunks()
        row = _row(nodes.column("part")[0].as_py(), np.stack([nodes.column(c).to_numpy() for c in names], axis=1))
        return row.append_column("nodes", pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named))

    shape = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("part", "n")), T.StructField("x", T.BinaryType()), T.StructField("nodes", T.ArrayType(degree.schema["node"].dataType))])
    rows = stage_buckets(places.select("part", "pos", "node", *[c.alias(x) for x, c in columns.items()]).groupBy("part").applyInArrow(first, shape), "spectral-nodes", "part", buckets)
    space = Buckets(edges.sparkSession, "spectral", "part", buckets)
    try:
        u, value = _eigenvectors(w, rows.select("part", "n", "x"), space, n, k, spare, blocks, tolerance, most_restarts)
        df, _ = _beside({"u": [space.read(u)]})
        schema = T.StructType([degree.schema["node"], T.StructField("u", T.ArrayType(T.DoubleType()))])
        wanted, top = to_arrow_schema(schema), len(value)

        def run(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    u, nodes = np.frombuffer(batch.column("u_0")[at].as_buffer(), np.float64), batch.column("nodes")[at].values
                    yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, top), pa.int32()), pa.array(u))], schema=wanted)

        return stage(df.join(rows.select("part", "nodes"), "part").mapInArrow(run, schema), "eigenvectors"), [float(1 - v) for v in value]
    finally:
        space.close()


def _eigenvectors(w: DataFrame, rows: DataFrame, space: Buckets, n: int, k: int, spare: int, blocks: int, tolerance: float, most_restarts: int) -> tuple[int, np.ndarray]:
    """The block of the ``k`` eigenvectors of ``w`` of greatest eigenvalues, and these, descending."""
    start = space.add(rows)
    r = _orthonormal(_products(lambda x: [x.T @ x], space, x=[start])[0])
    b, a, width = [_combined(lambda x: x @ r, space, x=[start])], [], r.shape[1]  # the space and its image, by blocks
    have = 0  # columns of b of which the image is in a
    for restart in range(most_restarts):
        for step in range(blocks):
            y = _multiplied(w, b[-1], width, space)
            a.append(y)
            have += width
            if step == blocks - 1 or have >= n:
                break
            # the new block: what the image adds to the space, made orthogonal twice
            c = _products(lambda b, y: [b.T @ y], space, b=b, y=[y])[0]
            once = lambda b, y, c=c: y - b @ c
            c2, gram = _products(lambda b, y: [b.T @ once(b, y), once(b, y).T @ once(b, y)], space, b=b, y=[y])
            gram = gram - c2.T @ c2
            r = _orthonormal(gram)
            if not r.shape[1] or gram.max() < 1e-24:
                break
            b, width = [*b, _combined(lambda b, y, c=c2, r=r: (once(b, y) - b @ c) @ r, space, b=b, y=[y])], r.shape[1]
        t, aa, bb = _products(lambda b, a: [b.T @ a, a.T @ a, b.T @ b], space, b=b, a=a)
        # the basis is orthonormal but for rounding, which is taken out here
        root = _orthonormal(bb)
        value, s = np.linalg.eigh(root.T @ ((t + t.T) / 2) @ root)
        order = np.argsort(-value)
        value, s = value[order], root @ s[:, order]
        top = min(k, len(value))
        residual = np.sqrt(np.maximum(np.einsum("ij,ij->j", s, aa @ s) - 2 * value * np.einsum("ij,ij->j", s, t @ s) + value**2, 0))[:top]
        if residual.max(initial=0) <= tolerance or have >= n:
            break
        # go on from the best vectors and from what they miss
        keep = min(k + spare, len(value))
        best, val = s[:, :keep], value[:keep]
        missed = lambda b, a, best=best, val=val: (a @ best) - (b @ best) * val
        c, gram = _products(lambda b, a: [(b @ best).T @ missed(b, a), missed(b, a).T @ missed(b, a)], space, b=b, a=a)
        r = _orthonormal(gram - c.T @ c)
        have, width = keep, r.shape[1]
        new = _combined(lambda b, a: (missed(b, a) - (b @ best) @ c) @ r, space, b=b, a=a)
        b, a = [_combined(lambda b: b @ best, space, b=b), new], [_combined(lambda a: a @ best, space, a=a)]
    else:
        raise RuntimeError(f"eigenvectors did not settle in {most_restarts} restarts: residuals {residual}")
    best = s[:, :top]
    return _combined(lambda b: b @ best, space, b=b), value[:top]


def spectral_clusters(edges: DataFrame, k: int, seed: int = 1, unit: bool = True, **how) -> DataFrame:
    """(node, cluster): k-means over the nodes' rows of the ``k`` least eigenvectors, by default scaled to length 1; with ``k`` nodes at most each is its own cluster."""
    u, _ = spectral_embedding(edges, k, seed=seed, **how)
    if u.limit(k + 1).count() <= k:
        return u.select("node", (F.row_number().over(Window.orderBy("node")) - 1).alias("cluster"))  # k rows
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))
    rows = u.select("node", array_to_vector(F.transform("u", lambda x: x / F.when(length > 0, length).otherwise(1.0)) if unit else F.col("u")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=50).fit(rows).transform(rows).select("node", F.col("prediction").alias("cluster"))
