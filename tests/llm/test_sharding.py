import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tablescape.llm import sharding


def plain_bfd(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(left) if r >= s]
        if s > capacity:
            left.append(-1)
        elif fit:
            _, i = min(fit)
            left[i] -= s
        else:
            left.append(capacity - s)
    return left


def test_packing_equals_itemwise_packing():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 120))]
        capacity = rng.randrange(20, 90)
        counts = defaultdict(int)
        for s in sizes:
            counts[s] += 1
        classes = sorted(counts.items(), reverse=True)
        placed = sharding.best_fit_decreasing(classes, capacity)
        load = defaultdict(int)
        for (s, n), runs in zip(classes, placed):
            assert sum(k for _, k in runs) == n
            for b, k in runs:
                load[b] += s * k
        want = plain_bfd(sizes, capacity)
        assert len(load) == len(want)
        assert sorted(capacity - v for b, v in load.items() if v <= capacity) == sorted(r for r in want if r >= 0)


def test_shards(docs, none):
    rows = sharding.op8_shard(docs).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, (r["doc_id"] for r in docs.collect())))
    texts = defaultdict(set)
    for r in docs.collect():
        texts[(r["doc_id"], zlib.crc32((r["text"] or "").encode()))].add(r["text"])
    where, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        (text,) = texts[(r["doc_id"], r["text_crc32"])]
        assert r["size"] == len((text or "").encode()) + 1
        where[text].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(v) == 1 for v in where.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    rest = sorted(load.values())[:-2]  # two groups exceed an equal share and stand alone
    assert len(load) == 8 and max(rest) <= 1.01 * min(rest)
    assert sharding.op8_shard(none).count() == 0


def test_near_equal_bytes(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "x" * int(rng.paretovariate(1.2) * 30)) for i in range(3000)], "doc_id bigint, text string")
    load = [r["b"] for r in sharding.op8_shard(df).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(load) == 8 and max(load) <= 1.01 * min(load)
    groups = defaultdict(int)
    for r in df.collect():
        groups[zlib.crc32(r["text"].encode())] += len(r["text"]) + 1
    packed = defaultdict(lambda: defaultdict(int))
    for r in sharding.pack_documents(df, 20000).collect():
        packed[r["shard"]][r["text_crc32"]] += r["size"]
    assert sum(len(g) for g in packed.values()) == len(groups)  # none divided
    assert all(sum(g.values()) <= 20000 or len(g) == 1 for g in packed.values())
    rest = sum(s for s in groups.values() if s <= 20000)
    assert len(packed) <= 1.1 * rest / 20000 + 1 + sum(s > 20000 for s in groups.values())


def test_carried_columns_keep_apart(docs):
    names = ["text", "size", "rank", "key", "slot", "row", "SHARD"]
    df = docs.select("doc_id", "text", "size", "rank", *[F.lit(n).alias(n) for n in names[3:]])
    got = sharding.shard_documents(df, 3, carry=tuple(names))
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "text", "size_", "rank", "key", "slot_", "row", "SHARD_"]
    assert got.where("size_ = 's' AND key = 'key' AND slot_ = 'slot' AND row = 'row' AND SHARD_ = 'SHARD'").count() == df.where("size = 's'").count()
