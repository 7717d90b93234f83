"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Packing looks at sizes alone, so it runs over a histogram of group sizes with
a bounded number of classes; each group then learns its shard from its rank
in its class. No group and no row passes through the driver.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.session import stage

#: Sizes are rounded up to this many significant bits before packing: at most 2^11 classes for each power of two, and bins at most 0.05 % below capacity for it.
SIZE_BITS = 12
#: Rows that one task ranks, about.
RANK_ROWS = 2048


@dataclass
class _Node:
    key: tuple
    heat: float
    left: "_Node | None" = None
    right: "_Node | None" = None


class BalancedTree:
    """A treap of (remaining capacity, bin): insert, delete and least key at or above a bound in logarithmic expected time."""

    def __init__(self):
        self.root, self._rng = None, random.Random(7)

    def _split(self, t, key):
        if t is None:
            return None, None
        if t.key < key:
            t.right, right = self._split(t.right, key)
            return t, right
        left, t.left = self._split(t.left, key)
        return left, t

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a.heat > b.heat:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b

    def insert(self, key):
        a, b = self._split(self.root, key)
        self.root = self._join(self._join(a, _Node(key, self._rng.random())), b)

    def delete(self, key):
        a, b = self._split(self.root, key)
        _, b = self._split(b, (*key[:-1], key[-1] + 1))
        self.root = self._join(a, b)

    def at_least(self, key):
        t, best = self.root, None
        while t is not None:
            if t.key >= key:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """For each (size, count), sizes descending: [(bin, how many)].

    Each item enters the bin with the least remaining capacity that holds it,
    or opens a bin; an item above the capacity gets a bin of its own. Items of
    one size follow each other into the same tightest bin until it is full, so
    a whole run is placed at once and the result is that of item-wise packing.
    """
    tree, bins, placed = BalancedTree(), 0, []
    for size, count in classes:
        runs = []
        while count:
            if size > capacity:
                runs += [(bins + i, 1) for i in range(count)]
                bins, count = bins + count, 0
                break
            found = tree.at_least((size, -1))
            if found is None:
                found = (capacity, bins)
                bins += 1
            else:
                tree.delete(found)
            n = min(count, found[0] // size) if size else count
            runs.append((found[1], n))
            count -= n
            tree.insert((found[0] - n * size, found[1]))
        placed.append(runs)
    return placed


def _bins_of(placed) -> int:
    return max((b + 1 for runs in placed for b, _ in runs), default=0)


def plan_shards(classes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Best-fit-decreasing into ``shards`` bins of the least capacity that suffices; sizes near equal.

    Groups larger than an equal share of what is left take a shard alone, the
    rest shares the others.
    """
    classes = sorted(classes, reverse=True)
    alone, rest, left = [], [list(x) for x in classes], shards
    while rest and left > 1:
        total = sum(s * n for s, n in rest)
        if rest[0][0] * left <= total:
            break
        alone.append(rest[0][0])
        left -= 1
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    todo = [tuple(x) for x in rest]
    total = sum(s * n for s, n in todo)
    low, high = max(1, -(-total // left)), max(1, total)
    while low < high:
        middle = (low + high) // 2
        if _bins_of(best_fit_decreasing(todo, middle)) <= left:
            high = middle
        else:
            low = middle + 1
    runs: dict[int, list] = {}
    for shard, size in enumerate(alone):
        runs.setdefault(size, []).append((shard, 1))
    for (size, _), placed in zip(todo, best_fit_decreasing(todo, low)):
        runs.setdefault(size, []).extend((len(alone) + b, n) for b, n in placed)
    return [runs[size] for size, _ in classes]


def ranked(df: DataFrame, by: list[str], order: list[str], rows: int = RANK_ROWS) -> DataFrame:
    """``df`` with ``rank``: gapless from 0 for each ``by``, without a window over a whole ``by`` group.

    Rows are dealt to buckets by a hash of ``order``; buckets are numbered from
    the bucket counts, and rows within a bucket. Deterministic in the rows.
    ``df`` is read twice and should be a written table.
    """
    n = max(1, -(-df.count() // rows))
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*[F.col(c) for c in order])) - 1
    return bucketed.withColumn("_own", own).join(starts, [*by, "_bucket"]).withColumn("rank", (F.col("_start") + F.col("_own")).cast("bigint")).drop("_bucket", "_own", "_start")


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, *carry): every row of ``docs`` in a shard 0 to ``shards``-1, bytes near equal."""
    return _placed(docs, lambda classes: plan_shards(classes, shards), text, doc_id, carry)


def pack_documents(docs: DataFrame, capacity: int, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """As ``shard_documents``, into as few shards of ``capacity`` bytes as best-fit-decreasing finds; a larger group has a shard alone."""
    return _placed(docs, lambda classes: best_fit_decreasing(classes, capacity), text, doc_id, carry)


def _placed(docs: DataFrame, plan, text: str, doc_id: str, carry: tuple[str, ...]) -> DataFrame:
    """The shards of ``plan`` for the rows of ``docs``.

    A group is the rows of equal text (by SHA-256; null is a group of its own)
    and is never divided. Size is the text's UTF-8 bytes plus 1; null counts
    as empty. Slots are gapless from 0 in each shard. Repeated rows and null
    ids each keep a slot. ``carry`` columns come along; one that shares its
    name with a column of the result gets an underscore after it. Other
    columns are ignored; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    result = ["doc_id", "size", "text_crc32", "shard", "slot"]
    named, held = [], [f"carried_{i}" for i in range(len(carry))]
    for c in carry:
        name = c
        while name.lower() in {x.lower() for x in [*result, *named]}:
            name += "_"
        named.append(name)
    base = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col(text), 256)), F.lit(b"")).alias("key"), F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(h) for c, h in zip(carry, held)],
        ),
        "sizes",
    )
    # groups, with sizes rounded up to SIZE_BITS significant bits
    g = base.groupBy("key").agg(F.sum("size").alias("bytes"))
    shift = F.greatest(F.lit(0), F.length(F.bin("bytes")) - SIZE_BITS)
    unit = F.expr("shiftleft(1L, shift)")
    groups = stage(g.withColumn("shift", shift).withColumn("unit", unit).select("key", (F.ceil(F.col("bytes") / F.col("unit")) * F.col("unit")).cast("bigint").alias("class")), "groups")
    # at most 2^11 classes for each power of two, whatever the input
    classes = sorted(((r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)
    spark, rows = docs.sparkSession, []
    for (size, _), runs in zip(classes, plan(classes)):
        at = 0
        for shard, n in runs:
            rows.append((size, at, at + n, shard))
            at += n
    runs = spark.createDataFrame(rows, "class bigint, first bigint, past bigint, shard int")
    # of one class a shard holds one run of ranks at most, so a class has as many runs as shards at most
    runs = runs.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("past", "shard"))).alias("runs"))
    to = stage(
        ranked(groups, ["class"], ["key"]).join(runs, "class")
        .select("key", F.expr("filter(runs, r -> r.past > rank)[0].shard").alias("shard")),
        "shard_of",
    )
    placed = stage(base.join(to, "key").select("doc_id", "size", "text_crc32", "shard", "row", *held), "placed")
    return ranked(placed, ["shard"], ["doc_id", "row"]).select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"), *[F.col(h).alias(c) for h, c in zip(held, named)])


def op8_shard(docs: DataFrame) -> DataFrame:
    """The contract's columns: law ``bytes`` over 8 shards."""
    return shard_documents(docs, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
