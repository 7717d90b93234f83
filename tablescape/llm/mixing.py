"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.llm.common import identified, unused
from tablescape.session import stage

#: Words in a block.
BLOCK = 64
#: Documents in a shard of a source, about: what one task orders at once; shards, or groups of them, that one task apportions.
SHARD_DOCS, FAN = 2048, 1024


def sainte_lague(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotient weight / (2 s + 1), none above its ``most``; ties to the first.

    Starts below the seats rounded at a common divisor and then gives to the
    highest quotient until the sum is right, which ends where one-by-one
    allocation would.
    """
    seats = min(seats, sum(m for m, w in zip(most, weights) if w > 0))
    low, high = 0.0, 2.0
    total = sum(weights) or 1.0
    at = lambda x: [min(m, int(w / total * seats * x + 0.5)) if w > 0 else 0 for w, m in zip(weights, most)]
    while sum(at(high)) < seats and high < 1e18:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle)) <= seats else (low, middle)
    got = [max(0, s - 1) for s in at(low)]  # one less each, so that ties at the divisor are dealt below, in order
    gain = [(-w / (2 * s + 1), i) for i, (w, s, m) in enumerate(zip(weights, got, most)) if w > 0 and s < m]
    heapq.heapify(gain)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(gain)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(gain, (-weights[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: list[int], weights: list[float], ratio: float, most: float) -> list[float]:
    """Shares of ``ratio`` times all sizes by weight, none above ``most`` times its own size; the excess goes to the others by weight."""
    left, open_ = ratio * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        if total <= 0:
            break
        share = left / total
        full = {i for i in open_ if weights[i] * share >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * share
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def cyclic_weights(n: int, cycle: tuple[float, ...] = (5, 2, 1)) -> list[float]:
    return [cycle[i % len(cycle)] for i in range(n)]


def mix(docs: DataFrame, ratio: float = 1.5, most: int = 2, cycle: tuple[float, ...] = (5, 2, 1), seed: int = 11, block: int = BLOCK, text: str = "text", source: str = "source", keys: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, size, source_size, target, taken): every row of ``docs`` and how many of its words the mix takes.

    Size is the number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0). Sources in
    code point order, null last, have the weights of ``cycle`` in turn and
    share ``ratio`` times all words (``targets``). The blocks of a source are
    apportioned to it, and then to its shards, by highest quotients; a shard
    puts its documents in a seeded order and gives its first blocks, again
    from the start where its quota exceeds one pass, so a document gives
    ``most`` times its size at most. A source whose target is ``most`` times
    its size gives all. Rows without words take 0; repeated rows are rows of
    their own; an empty table gives an empty result.

    Shard and order hang on the row's content alone (keys, source, text, and
    its number among equal rows), so any partitioning of the same rows gives
    the same result. Where ``keys`` tell rows apart but say nothing of their
    content, name columns that do in ``order``: these, source and text count.

    A source is dealt to shards of ``SHARD_DOCS`` documents about, so a hot
    source is many groups; ``FAN`` shards make a group, ``FAN`` groups the next
    one, and the blocks go down this tree, so no task apportions more than
    ``FAN`` at once. The driver sees one row a source.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    rows = docs.select(*keys, F.col(source).alias("_source"), words.alias("size"), F.xxhash64(*(order or keys), source, text, F.lit(seed)).alias("_content"))
    if not order:  # equal rows are counted, which is combined before the shuffle, and dealt out again with their numbers
        rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    else:
        rows = rows.withColumn("_n", F.lit(1))
    rows = stage(rows, "words")
    per = rows.groupBy("_source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()
    per.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))  # Python orders by code point
    sizes = [r["words"] for r in per]
    goal = targets(sizes, cyclic_weights(len(per), cycle), ratio, most)
    whole = [g >= most * s for g, s in zip(goal, sizes)]
    seats = round(sum(g for g, w in zip(goal, whole) if not w) / block)
    quota = sainte_lague([0.0 if w else g for g, w in zip(goal, whole)], seats, [most * s // block for s in sizes])
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(r["_source"], s, float(g), w, q, max(1, -(-r["docs"] // SHARD_DOCS))) for r, s, g, w, q in zip(per, sizes, goal, whole, quota)],
        "_source string, source_size bigint, target double, whole boolean, quota bigint, shards int",
    )
    at = F.xxhash64("_content", "_n")
    plan_side = plan.select(F.col("_source").alias("_plan_source"), "source_size", "target", "whole", "quota", "shards")
    dealt = stage(
        rows.withColumn("_at", at).join(plan_side, F.col("_source").eqNullSafe(F.col("_plan_source"))).drop("_plan_source").withColumn("_shard", F.pmod("_at", F.col("shards")).cast("int")),
        "dealt",
    )

    shards = dealt.groupBy("_source", F.col("_shard").alias("node")).agg(F.sum("size").alias("words"), F.max("quota").alias("quota"))
    levels = [stage(shards.withColumn("most", F.floor(most * F.col("words") / block)), "shards")]
    n = max((-(-r["docs"] // SHARD_DOCS) for r in per), default=1)
    while n > FAN:
        n = -(-n // FAN)
        levels.append(levels[-1].groupBy("_source", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(F.sum("words").alias("words"), F.max("quota").alias("quota"), F.sum("most").alias("most")))

    def divided(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        return pdf.assign(blocks=sainte_lague([float(x) for x in pdf["words"]], int(pdf["quota"].iloc[0]), [int(x) for x in pdf["most"]]))[["_source", "node", "words", "blocks"]]

    schema = "_source string, node int, words bigint, blocks bigint"
    quotas = levels[-1].groupBy("_source").applyInPandas(divided, schema)
    for level in levels[-2::-1]:
        above = quotas.select(F.col("_source").alias("_up"), F.col("node").alias("up"), F.col("blocks").alias("given"))
        inner = level.join(above, F.expr("_source <=> _up AND floor(node / {fan}) = up".replace("{fan}", str(FAN)))).withColumn("quota", F.col("given"))
        quotas = inner.groupBy("_source", "up").applyInPandas(divided, schema)
    quotas = stage(quotas.select(F.col("_source").alias("_q_source"), F.col("node").alias("_q_shard"), "words", "blocks"), "quotas")
    before = Window.partitionBy("_source", "_shard").orderBy("_at", *keys, "size", "_content", "_n").rowsBetween(Window.unboundedPreceding, -1)
    tape = dealt.withColumn("_from", F.coalesce(F.sum("size").over(before), F.lit(0)))
    tape = tape.join(quotas, F.expr("_source <=> _q_source AND _shard = _q_shard"))
    takes = F.col("blocks") * block
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), takes - i * F.col("words") - F.col("_from"))) for i in range(most)]
    taken = F.when(F.col("whole"), most * F.col("size")).otherwise(sum(passes[1:], passes[0]))
    return tape.select(*keys, "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus as rows of ``docs``: each document whole, as often as the words it gives make its size up, rounded (0, 1 or 2 times).

    All columns stay, whatever their names. Rows without words (null and empty
    texts) are not taken; repeated rows are rows of their own; an empty table
    gives an empty result. ``docs`` is read twice; its rows are known again by
    their place in a file (``identified``). The order hangs on all columns and
    the place in the file, which parts equal rows.
    """
    own, tag = docs.columns, unused(docs, "row_tag")
    times, copy = unused(docs, "row_times"), unused(docs, "row_copy")
    rows = identified(docs, tag)
    content = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))])
    plain = rows.select(F.col(tag).alias("tag"), content.alias("content"), F.col(f"{tag}.row").alias("place"), F.col(how.pop("text", "text")).alias("text"), F.col(how.pop("source", "source")).alias("source"))
    found = mix(plain, keys=("tag",), order=("content", "place"), **how).select(F.col("tag").alias(tag), F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int").alias(times)).where(F.col(times) > 0)
    return rows.join(found, tag).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*own)


def op6_mix(docs: DataFrame) -> DataFrame:
    return mix(docs)
