"""Each stage of the pipeline against its operator's brute-force version, on one small corpus."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tablescape.llm import decontamination, mixing, quality
from tests.llm.test_simhash import kept_by_brute_force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder):
    rng = random.Random(7)
    good = lambda n: " ".join(rng.choice(["river", "stone", "the", "walks", "of", "light", "dusk", "every"]) + str(rng.randrange(99)) for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(20))
    rows, labels = [], []
    for i in range(240):
        text = good(rng.randrange(30, 150))
        if i % 10 == 1:
            text = rows[-1][1]
        if i % 10 == 2:
            text = good(20) + " " + item
        if i % 10 == 3:
            text = "".join(w + "$$$ ### " for w in text.split())
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 0 if i % 10 == 3 else 1, 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", None, 0), rows[0], (None, good(40), "en", "s0", 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "short thing here")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    write(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "shard"] and corpus_pipeline.ORACLE_SQL is None
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        if name != "shard":
            assert out.columns == COLUMNS
            out.write.parquet(f"{sf}/{name}")
            out = spark.read.parquet(f"{sf}/{name}")
        before, after = docs.collect(), out.collect()
        ids = lambda rs: sorted(r["doc_id"] for r in rs if r["doc_id"] is not None and r["doc_id"] < 1000)
        if name == "quality":
            scores = quality.scored(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
            assert sorted(map(str, after)) == sorted(str(type(after[0])(**{c: r[c] for c in COLUMNS})) for r in scores if r["score"] >= quality.THRESHOLD)
            assert not any(i % 10 == 3 for i in ids(after)) and sum(i % 10 != 3 for i in ids(after)) >= 0.98 * sum(i % 10 != 3 for i in ids(before))
        if name == "near_dedup":
            want = kept_by_brute_force([(r["doc_id"], r["text"]) for r in before])
            assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in after)
        if name == "decontaminate":
            clean = [r for r in before if "bench0" not in (r["text"] or "")]
            assert sorted(map(str, clean)) == sorted(map(str, after)) and len(clean) < len(before)
        if name == "mix":
            size = lambda rs, s: sum(len((r["text"] or "").split()) for r in rs if r["source"] == s)
            sources = sorted({r["source"] for r in before if r["source"] is not None})
            sizes = [size(before, s) for s in sources] + [size(before, None)]
            goal = mixing.targets(sizes, mixing.cyclic_weights(len(sizes)), 1.5, 2)
            for s, g in zip([*sources, None], goal):
                assert abs(size(after, s) - g) <= 300, (s, g, size(after, s))
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        if name == "shard":
            assert len(after) == len(before) and {r["shard"] for r in after} <= set(range(8))
            where = {}
            for r in after:
                where.setdefault(r["text"], set()).add(r["shard"])
            assert all(len(x) == 1 for x in where.values())
        docs = out if name != "shard" else docs
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == docs.count() and "slot" in whole.columns


def test_columns_of_any_name_stay(spark, tmp_path):
    sf = str(tmp_path)
    write(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["_tag", "_row", "_copy", "_times", "_quality", "quality_score", "row_tag", "row_times", "row_copy", "key", "fp", "part", "size", "slot", "shard"]
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n + " of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs.write.parquet(f"{sf}/wide")
    docs = spark.read.parquet(f"{sf}/wide")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        if name == "shard":
            assert set(names) <= {c.rstrip("_") for c in out.columns}
            out = out.select("doc_id", *[F.col(n + "_" * (n in ("size", "slot", "shard"))).alias(n) for n in names])
        else:
            assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    write(spark, f"{sf}/full")
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/full/{t}.parquet").where("false").write.parquet(f"{sf}/{t}.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
    assert decontamination.WINDOW == 13
