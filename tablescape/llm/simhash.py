"""SimHash near-duplicates: exact linking of fingerprints within a Hamming radius.

Fingerprints are compared tile against tile with numpy exclusive-or and bit
counts. A tile holds fingerprints whose four 16-bit quarters have the same
population counts; two fingerprints that differ in ``radius`` bits have
population counts that differ by ``radius`` in sum at most, so only tiles that
near are paired. Nothing that could link is skipped.

Fingerprints of shingles move several bits when a few words change. Copies
with changed words are therefore also sought by a second fingerprint, that of
the single words, which moves less: tiles are then keyed by it, and a link
holds if both fingerprints are near (``NEAR``). Such links are candidates:
before a document goes for one, its shingles are compared exactly.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.llm.common import arrow_map, ascii_words, identified, unused
from tablescape.operators.components import connected_components
from tablescape.session import stage

#: Fingerprints in a tile, about; a cell with more is dealt to several tiles.
TILE = 1024
#: Tiles of one cell that meet the same partner in one join key.
SALT = 8
#: Bits by which the fingerprints of words and of shingles may differ in copies with changed words.
NEAR = (3, 9)
#: Words in a shingle, and the share of shingles, by Jaccard, from which such copies are near-duplicates.
SHINGLE, LEAST = 5, 0.8


def fingerprint_of(words: list[bytes], width: int = 3) -> int:
    """64-bit SimHash of the shingles of ``width`` words; fewer words are one shingle, none give zero."""
    import xxhash

    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    join = b" ".join([b"%b"] * width)
    shingles = (join % x for x in zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    bits, n = np.zeros(64, np.int64), 0
    while got := [h(x, 42) for x in itertools.islice(shingles, 1 << 16)]:  # bounded memory however long the text
        bits += np.unpackbits(np.array(got, np.uint64).view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(got)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: bool = False) -> DataFrame:
    """The ``keep`` columns and ``fp`` (long, the fingerprint's bits), with ``words`` also ``words``, that of single words. Null text counts as empty: fingerprints zero."""
    fields = [docs.schema[c] for c in keep]
    widths = {"fp": 3, "words": 1} if words else {"fp": 3}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} bigint" for n in widths)])

    def make(batch):
        got = []
        for whole in batch.column(len(keep)).to_pylist():
            split = ascii_words(whole)
            got.append([fingerprint_of(split, w) for w in widths.values()])
        fps = np.array(got, np.uint64).reshape(-1, len(widths)).view(np.int64)
        return {**{f.name: batch.column(i) for i, f in enumerate(fields)}, **{n: pa.array(fps[:, i]) for i, n in enumerate(widths)}}

    return arrow_map(docs.select(*keep, text), make, schema)


def _quarters(fp: F.Column) -> list[F.Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]


def _near_offsets(radius: int) -> list[tuple[int, ...]]:
    """Offsets between the quarters' population counts that a link can have; of each pair (x, -x) one."""
    span = range(-radius, radius + 1)
    return [x for x in itertools.product(span, repeat=4) if sum(map(abs, x)) <= radius and x >= (0, 0, 0, 0)]


def spanning_edges(a: np.ndarray, b: np.ndarray, radius: int, words: tuple[np.ndarray, np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between ``a`` and ``b`` connect: from each component's first member to the others.

    With ``words`` (their other fingerprints and the radius of these) a link must hold in both.
    """
    near = np.empty((len(a), len(b)), bool)
    first, second, most = words or (a, b, radius)
    for at in range(0, len(a), 256):
        near[at : at + 256] = np.bitwise_count(first[at : at + 256, None] ^ second[None, :]) <= most
    if words:
        i, j = np.nonzero(near)
        near[i, j] = np.bitwise_count(a[i] ^ b[j]) <= radius
    rows, src, dst = near.any(1), [], []
    for i in np.flatnonzero(rows):
        if not rows[i]:
            continue
        in_rows, in_cols = np.zeros(len(a), bool), np.zeros(len(b), bool)
        new = np.array([i])
        while len(new):
            in_rows[new] = True
            cols = np.flatnonzero(near[new].any(0) & ~in_cols)
            if not len(cols):
                break
            in_cols[cols] = True
            new = np.flatnonzero(near[:, cols].any(1) & ~in_rows)
        rows &= ~in_rows
        members = np.unique(np.concatenate([a[in_rows], b[in_cols]]))
        members = members[members != a[i]]
        src.append(np.full(len(members), a[i]))
        dst.append(members)
    none = np.empty(0, np.uint64)
    return np.concatenate(src or [none]), np.concatenate(dst or [none])


def nearest_forest(a: np.ndarray, b: np.ndarray, radius: int, words: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``a`` and ``b`` that form a spanning forest of least differing bits: among them each fingerprint's nearest link."""
    i, j = (np.concatenate(x) for x in zip(*((at + r, c) for at in range(0, len(a), 256) for r, c in [np.nonzero(np.bitwise_count(words[0][at : at + 256, None] ^ words[1][None, :]) <= words[2])])))
    bits = np.bitwise_count(a[i] ^ b[j]).astype(np.int64)
    keep = (bits <= radius) & (a[i] != b[j])
    i, j, bits = i[keep], j[keep], bits[keep] + np.bitwise_count(words[0][i[keep]] ^ words[1][j[keep]])
    fps, ends = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    order = np.lexsort((ends[len(i) :], ends[: len(i)], bits))
    u, v = ends[: len(i)][order], ends[len(i) :][order]
    root, taken = np.arange(len(fps)), []
    while True:
        ru, rv = root[u], root[v]
        open_ = np.flatnonzero(ru != rv)
        if not len(open_):
            break
        least = np.full(len(fps), len(u))
        np.minimum.at(least, ru[open_], open_)
        np.minimum.at(least, rv[open_], open_)
        chosen = np.unique(least[least < len(u)])
        taken.append(chosen)
        parent = np.arange(len(fps))
        for x, y in zip(ru[chosen].tolist(), rv[chosen].tolist()):
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]
    edges = np.concatenate(taken or [np.empty(0, np.int64)])
    return fps[u[edges]], fps[v[edges]]


def linking_edges(fps: DataFrame, radius: int = 3, words_radius: int | None = None, links: bool = False) -> DataFrame:
    """(src, dst): edges over the distinct ``fp`` of ``fps`` with the components of all links within ``radius`` bits.

    With ``words_radius`` the rows also have ``words``, another fingerprint,
    which keys the tiles and must be within ``words_radius`` bits too. With
    ``links`` as well every edge is itself a link, the nearest ones that span
    (``nearest_forest``).

    A tile pair gives a spanning forest of its links, not every link, so a
    dense group of n fingerprints gives edges in proportion to n for each tile
    pair. A tile pair is one row of the join; tiles of a full cell are salted.
    """
    spark = fps.sparkSession
    q = ["q0", "q1", "q2", "q3"]
    both = words_radius is not None
    by, most = ("words", words_radius) if both else ("fp", radius)
    cols = ["fp", "words"] if both else ["fp"]
    cells = stage(fps.select(*cols).distinct().select(*cols, *[c.alias(n) for c, n in zip(_quarters(F.col(by)), q)]), "cells")
    # at most 17^4 cells whatever the input's size: safe to broadcast
    sizes = cells.groupBy(*q).agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    tiles = stage(
        cells.join(F.broadcast(sizes), q)
        .withColumn("chunk", F.pmod(F.xxhash64(*cols), F.col("chunks")).cast("int"))
        .groupBy(*q, "chunks", "chunk")
        .agg(F.collect_list(F.struct(*cols) if both else "fp").alias("fps")),
        "tiles",
    )
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(q, x)]) for x in _near_offsets(most)])
    left = tiles.select(F.explode(offsets).alias("d"), *q, F.col("chunk").alias("chunk_a"), F.col("fps").alias("a")).select(
        *[(F.col(n) + F.col(f"d.{n}")).alias(n) for n in q], F.expr("d.q0 = 0 AND d.q1 = 0 AND d.q2 = 0 AND d.q3 = 0").alias("own"), "chunk_a", "a"
    ).join(F.broadcast(sizes), q).withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("chunks") / SALT)).cast("int")).drop("chunks")
    right = tiles.select(*q, F.col("chunk").alias("chunk_b"), F.col("fps").alias("b"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("chunks") / SALT).cast("int") - 1)).alias("salt"))
    pairs = left.join(right, [*q, "salt"]).where("NOT own OR chunk_a <= chunk_b").select("a", "b")

    def lists(column):
        parts = column.values.flatten() if both else [column.values]
        return [x.to_numpy(zero_copy_only=False).view(np.uint64) for x in parts], column.offsets.to_numpy()

    def make(batch):
        (a, ao), (b, bo) = lists(batch.column(0)), lists(batch.column(1))
        got = []
        for i in range(batch.num_rows):
            at, to = slice(ao[i], ao[i + 1]), slice(bo[i], bo[i + 1])
            got.append((nearest_forest if links else spanning_edges)(a[0][at], b[0][to], radius, (a[1][at], b[1][to], words_radius) if both else None))
        return {k: pa.array(np.concatenate([g[j] for g in got]).view(np.int64)) for j, k in enumerate(("src", "dst"))}

    return arrow_map(pairs, make, "src bigint, dst bigint", most_bytes=16 << 20).where("src <> dst").distinct()


def _parts(found: DataFrame, classes: DataFrame, radius: int, near: tuple[int, int] | None) -> DataFrame:
    """(node, component): the components of the fingerprints in ``classes``, by links within ``radius`` bits and by those of ``near``."""
    edges = linking_edges(classes, radius)
    if near:
        edges = edges.unionByName(linking_edges(found, near[1], near[0])).distinct()
    return stage(connected_components(stage(edges, "links")), "part")


def near_duplicates(docs: DataFrame, radius: int = 3, text: str = "text", doc_id: str = "doc_id", near: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, fp, component_id): every document with its fingerprint and the least doc_id its links reach.

    Documents link if their fingerprints differ in ``radius`` bits at most;
    equal fingerprints are one class, so copies are never expanded into pairs.
    With ``near`` they also link if the fingerprints of their words differ in
    ``near[0]`` bits and those of their shingles in ``near[1]`` bits at most.
    Null text counts as empty (fingerprint zero, linked like any other);
    repeated rows stay; a null doc_id is carried and never the least unless
    its component has no other. Extra columns are ignored. An empty table gives
    an empty result.
    """
    found = stage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=bool(near)), "fp")
    classes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "class")
    parts = _parts(found, classes, radius, near)
    rooted = classes.join(parts, classes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    to = stage(rooted.join(named, "root").select("fp", "component_id"), "named")
    return found.join(to, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; fewer words are one shingle, none give none."""
    import xxhash

    words = ascii_words(text)
    runs = (b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r) for r in runs), np.uint64))


def alike(pairs: DataFrame, rows: DataFrame, tag: str, least: float = LEAST, text: str = "text") -> DataFrame:
    """The ``pairs`` (one, other), tags of ``rows``, whose texts share ``least`` of their five-word shingles by Jaccard, counted exactly."""
    ends = pairs.select(F.explode(F.array("one", "other")).alias(tag)).distinct()
    kind = rows.schema[tag].dataType.simpleString()

    def hashed(batch):
        return {"end": batch.column(0), "set": pa.array([shingle_set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())}

    sets = stage(arrow_map(rows.join(ends, tag, "left_semi").select(tag, text), hashed, f"end {kind}, set binary"), "shingles")
    both = pairs.join(sets.select(F.col("end").alias("one"), F.col("set").alias("a")), "one").join(sets.select(F.col("end").alias("other"), F.col("set").alias("b")), "other").select("one", "other", "a", "b")

    def judged(batch):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(shared >= least * (len(x) + len(y) - shared))
        return {"one": batch.column(0).filter(pa.array(keep, pa.bool_())), "other": batch.column(1).filter(pa.array(keep, pa.bool_()))}

    return arrow_map(both, judged, f"one {kind}, other {kind}", most_bytes=16 << 20)


def keep_first(docs: DataFrame, radius: int = 3, near: tuple[int, int] | None = NEAR) -> DataFrame:
    """The documents without near-duplicates: of each group one row, that of the least doc_id (nulls last), with all columns.

    Groups are the components of fingerprints within ``radius`` bits. With
    ``near``, the wider links that are nearest are candidates; groups are one
    if the first rows of two fingerprints so linked share ``LEAST`` of their
    five-word shingles, by Jaccard and counted exactly. Of rows that share this
    doc_id the first stays, by file and place in it. Null
    text counts as empty, all empty texts are one group; columns of any name
    stay; an empty table gives an empty result. ``docs`` is read several times;
    its rows are known again by their place in a file (``identified``), however
    the scans are split.
    """
    own, tag = docs.columns, unused(docs, "row_tag")
    rows = identified(docs, tag)
    found = stage(fingerprints(rows.select("doc_id", "text", F.col(tag).alias("row")), keep=("doc_id", "row"), words=bool(near)), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("first")
    classes = stage(found.groupBy("fp").agg(first), "class")
    parts = _parts(found, classes, radius, None)
    rooted = stage(classes.join(parts, classes.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("first").alias("first"))
    if not near:
        return rows.join(groups.select(F.col("first.row").alias(tag)), tag, "left_semi").select(*own)
    end = lambda fp, row, group: rooted.select(F.col("fp").alias(fp), F.col("first.row").alias(row), F.col("root").alias(group))
    wide = linking_edges(found, near[1], near[0], links=True).join(end("src", "one", "a"), "src").join(end("dst", "other", "b"), "dst").where("a <> b")
    wide = stage(wide.select("one", "other", "a", "b").distinct(), "wide")
    same = stage(wide.join(alike(wide.select("one", "other").distinct(), rows, tag), ["one", "other"], "left_semi").select("a", "b").distinct(), "same")
    joined = connected_components(same, "a", "b")
    groups = groups.join(joined, groups.root == joined.node, "left").groupBy(F.coalesce("component", "root").alias("group")).agg(F.min("first").alias("first"))
    return rows.join(groups.select(F.col("first.row").alias(tag)), tag, "left_semi").select(*own)


def op3_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs, radius=3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
