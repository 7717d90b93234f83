import random
import zlib

import numpy as np
import pytest

from tablescape.llm import quality


def test_passages_cover_whole_texts():
    texts = ["", None, "abc", "x" * 512, "y" * 513, "é" * 5000]
    x, starts = quality.passages(texts)
    sizes = np.diff([*starts, len(x)])
    assert sizes.tolist() == [1, 1, 1, 1, 2, -(-10000 // 512)]
    assert (x[0] == 0).all() and (x[1] == 0).all()
    assert x[starts[2], ord("a")] == pytest.approx((1 / 3) ** 0.5)
    for i, t in enumerate(texts):
        alone, _ = quality.passages([t])
        assert np.allclose(alone, x[starts[i] : starts[i] + sizes[i]])
    many, s = quality.passages(["ab c" * 600_000])
    assert len(many) == -(-2_400_000 // 512) and np.allclose((many[:, :256] ** 2).sum(1), 1, atol=1e-5)


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    x, starts = rng.random((9, quality.FEATURES)).astype(np.float32), np.array([0, 1, 4])
    y = np.array([1.0, 0.0, 1.0])
    m = quality.BagModel(1)
    m.p["c"] = rng.normal(size=quality.HIDDEN).astype(np.float32)
    loss = lambda: float(np.mean([-np.log(s) if t else -np.log(1 - s) for s, t in zip(m.score(x, starts), y)]))
    g = m.gradients(x, starts, y)
    for k in m.p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        m.p[k][at] += 5e-3
        up = loss()
        m.p[k][at] -= 1e-2
        assert g[k][at] == pytest.approx((up - loss()) / 1e-2, rel=0.1, abs=1e-4), k
        m.p[k][at] += 5e-3


def tables(spark, n=400):
    rng = random.Random(1)
    good = lambda k: " ".join(rng.choice(["river", "stone", "the", "walks", "of", "light"]) for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        body = good(rng.randrange(20, 400))
        if bad:  # one bad stretch in the text
            cut = len(body) // 2
            body = body[:cut] + " BUY!!! $$$ ###" * 40 + body[cut:]
        rows.append((i, body, "en", "s", 0, "clash"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(9000, None, None, None, None, None), (9001, "", "", "", 0, ""), (None, good(30), "en", "s", 0, "x"), (9002, good(100), "en", "s", 0, "x"), (9002, good(100), "en", "s", 0, "x"), (9003, good(60_000), "en", "s", 0, "x")]
    labels += [(None, 1, 0), (3, None, 0), (9001, 1, 0), (9000, 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_columns(spark):
    docs, labels = tables(spark)
    rows = quality.op10_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400:
            right.append(r["predicted"] == int(r["doc_id"] % 4 != 0))
    assert len(right) > 40 and np.mean(right) > 0.95
    again = quality.op10_quality(docs, labels).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_repeated_rows_of_a_document_teach_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "other"), (3, "third"), (4, None)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)] + [(1, 1), (1, 1)], "doc_id bigint, quality int")
    seen, fit = [], quality.BagModel.fit
    monkeypatch.setattr(quality.BagModel, "fit", lambda self, bags, y: seen.append(len(bags)) or fit(self, bags, y))
    quality.train(docs, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2, 3, 4))]


def test_all_passages_of_the_chosen_documents_teach(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i} " * 4000) for i in range(40)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    whole = {i: len(quality.passages([f"{i} " * 4000])[0]) for i in range(40)}
    seen = []
    monkeypatch.setattr(quality.BagModel, "fit", lambda self, bags, y: seen.append([len(b) for b in bags]) or self)
    quality.train(docs, labels)
    assert sorted(seen[0]) == sorted(whole[i] for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 0)
    quality.train(docs, labels, most_passages=200)
    assert 0 < sum(seen[1]) <= 200 and set(seen[1]) <= set(whole.values())
    quality.train(docs, labels, most_passages=1)
    assert len(seen[2]) == 1 and seen[2][0] in whole.values()


def test_no_labels_and_no_documents(spark):
    docs, labels = tables(spark, 20)
    assert {r["score"] for r in quality.op10_quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality.op10_quality(docs.where("false"), labels).count() == 0
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
