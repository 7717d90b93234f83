"""Resampling against a brute-force version."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescape.llm import dsir

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall((text or "").encode().lower())
    return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target):
    found = [(i, *grams(t)) for i, t in rows]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, g in found:
        np.add.at(s, g, 1)
    for x in target:
        np.add.at(t, grams(x)[1], 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10_000) / ((int(a) + 1) * (int(t.sum()) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, n, g in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in g)
        out.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: 5 * len(able) // 100]


def test_against_brute_force(spark, docs, none, monkeypatch):
    monkeypatch.setattr(dsir, "BATCH_BYTES", 4096)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(1000 + i, f"gamma{i % 9} of the épée {i} " * 12) for i in range(300)] + [(1299, f"gamma{299 % 9} of the épée 299 " * 12)] * 3
    more = docs.unionByName(spark.createDataFrame(rows[-303:], "doc_id bigint, text string"), allowMissingColumns=True)
    target = ["Gamma1 of the ÉPÉE épée one", None, "", "alpha3 beta4, alpha3", "x" * 100 + " y"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id bigint, text string, doc_id int")
    got = dsir.resample(more, bench).collect()
    want, drawn = brute(rows, target)
    key = lambda x: str(tuple(x))
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(want, key=key)
    top = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in top] == list(range(1, len(drawn) + 1)) and len(drawn) > 15
    assert [(r["doc_id"], r["score"]) for r in top] == [(r[0], r[4]) for r in drawn]
    assert dsir.op11_resample(more, bench).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert dsir.op11_resample(none, bench).count() == 0
    assert dsir.op11_resample(docs, bench.where("false")).count() == docs.count()


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_partitions_do_not_matter(spark, docs, parts):
    bench = spark.createDataFrame([(1, "alpha1 of the beta2")], "item_id bigint, text string")
    many = docs.withColumn("text", F.concat_ws(" ", *["text"] * 9))
    seen = lambda df: sorted(map(str, dsir.op11_resample(df, bench).collect()))
    assert seen(many.repartition(parts)) == seen(many)


def test_ranks_over_ranges(spark):
    from tablescape.session import stage

    rows = stage(spark.range(1000).select(F.col("id").alias("row"), (F.col("id") % 7).alias("score")), "t")
    got = dsir.ranked(rows, [F.desc("score"), F.col("row")], 8).collect()
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [r["row"] for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 1001))


def test_checksums_are_carried_on():
    names = [b" a", b" " + b"x" * 63, b" " + b"y" * 64, b" " + b"z" * 5000, b" \xc3\xa9", b" a1"]
    crc_of = np.array([zlib.crc32(n) for n in names], np.uint32)
    start = np.array([0, 1, 0xFFFFFFFF, 0x80000000, 123456789, zlib.crc32(b"word")] * 6, np.uint32)
    word = np.repeat(np.arange(6), 6)
    assert dsir.carried_on(start, names, crc_of, word).tolist() == [zlib.crc32(names[w], int(c)) for c, w in zip(start, word)]


def test_slices_and_batches():
    texts = ["One two, three", None, "", "--", "ÄÖ ß one", "a b c d " * 50, "solo"]
    whole = pa.array(texts)
    for at in range(len(texts)):
        n, flat, ends = dsir.ngram_buckets(whole[at:])
        for i, t in enumerate(texts[at:]):
            words, want = grams(t)
            assert n[i] == words and flat[ends[i] : ends[i + 1]].tolist() == want
