import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tablescape.llm import lexicon, lm

PATH = P.path("word_bpe_49k.json")


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def test_counts_and_base_score(docs, none, monkeypatch):
    monkeypatch.setattr(lexicon, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(lexicon, "TASK_TERMS", 100)
    monkeypatch.setattr(lm, "LEAST_STEPS", 3)
    monkeypatch.setattr(lm, "PIECE_WORDS", 500)
    rows = docs.collect()
    split = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for r in rows if not held(r["doc_id"]) for w in split(r["text"]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r["doc_id"]), held(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for r in rows for w in [split(r["text"])])
    out = lm.op1_lm_scores(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert lm.op1_lm_scores(none, PATH).count() == 0
    alone = lm.op1_lm_scores(docs.where("doc_id IN (%s)" % ",".join(str(i) for i in range(50) if held(i))), PATH).collect()
    assert alone and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in alone)


def test_terms_dealt_to_several_tasks(docs, monkeypatch):
    few = docs.where("doc_id < 120")
    want = {(r["doc_id"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.op1_lm_scores(few, PATH).collect()}
    monkeypatch.setattr(lexicon, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lexicon, "TERM_BLOCKS", 3)
    got = lm.op1_lm_scores(few, PATH).collect()
    assert {(r["doc_id"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got} == want


def test_extra_columns_and_clashing_names(docs):
    few = docs.where("doc_id < 40").withColumn("turn", F.lit(9)).withColumn("block", F.lit("x")).withColumn("training", F.lit(None).cast("boolean"))
    assert lm.op1_lm_scores(few, PATH).count() == few.count()


def cells(vocab, ids, ends):
    return np.bincount(lm.cells_of(vocab, ids, ends), minlength=lm.CELLS).astype(np.float32)


def small_model():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, 500).astype(np.int64)
    plain = lm.Vocabulary(counts, 498, 499)
    ids = rng.choice(498, 4000, p=(counts[:498] + 1) / (counts[:498] + 1).sum())
    vocab = lm.Vocabulary(counts, 498, 499, cells(plain, ids, np.arange(100, 4001, 100)))
    model = lm.Attention(vocab, seed=4)
    for key in "GO":
        model.p[key] = model.p[key] * 8
    return vocab, model


def test_cells_by_hand():
    vocab = lm.Vocabulary(np.array([5, 4, 3, 2, 1, 0]), 4, 5)
    got = Counter(lm.cells_of(vocab, np.array([0, 1, 0]), np.array([2, 2, 3])).tolist())
    want, row, klass = Counter(), vocab.row, vocab.klass
    for doc in ([0, 1], [], [0]):
        a, b = [4, *doc], [*doc, 5]
        for i in range(len(a)):
            want[int(row[a[i]] * lm.ROWS + row[b[i]])] += 1
            for lag in range(lm.LAGS):
                if i + lag < len(b):
                    want[int(lm.ROWS**2 + (lag * lm.ROWS + row[a[i]]) * lm.CLASSES + klass[b[i + lag]])] += 1
    assert got == want


def test_probabilities_sum_to_one():
    vocab, model = small_model()
    ids = np.arange(500)
    rows = vocab.row[np.random.default_rng(1).integers(0, 500, (3, lm.CHUNK))]
    for place in (0, 5, lm.CHUNK - 1):
        total = 0.0
        for i in ids:
            klass = np.full((2, lm.CHUNK), vocab.klass[i])
            total += np.exp(model.log_class(rows, np.array([False, True]), klass)[:, place].astype(float) + vocab.log_share(rows[1:, place], np.full(2, i)))
        assert np.abs(total - 1).max() < 1e-3


def test_rare_ids_share_a_row():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 9, lm.ROWS + 500).astype(np.int64)
    n = len(counts)
    ids = rng.integers(0, n - 2, 5000)
    vocab = lm.Vocabulary(counts, n - 2, n - 1, cells(lm.Vocabulary(counts, n - 2, n - 1), ids, np.array([5000])))
    for k in range(0, lm.CLASSES, 17):
        of = np.flatnonzero(vocab.klass == k)
        if len(of):
            assert abs(np.exp(vocab.log_share(np.full(len(of), 3), of)).sum() - 1) < 1e-3


def plainly(model, vocab, doc):
    """One id after another, each window built anew."""
    seq, want, w, d, p = [vocab.begin, *doc], 0.0, lm.WIDTH, lm.HIDDEN, model.p
    for t in range(len(seq)):
        a = max(0, (t // lm.CHUNK - 1) * lm.CHUNK)
        x = vocab.embedding[vocab.row[seq[a : t + 1]]] @ p["M"]
        bias = p["B"][t % lm.CHUNK][(lm.CHUNK if t < lm.CHUNK else 0) :][: len(x)]
        s = x[:, w : 2 * w] @ x[-1, :w] + bias
        e = np.exp(s - s.max())
        h = np.clip((e / e.sum()) @ x[:, 2 * w : 2 * w + d] + x[-1, 2 * w + d :] + p["b"], 0, lm.MOST_HIDDEN)
        to, before = [*doc, vocab.end][t], vocab.row[seq[t]]
        group, inner = divmod(int(vocab.klass[to]), lm.INNER)
        g = vocab.groups[before] * np.exp(h @ p["G"])
        i = vocab.inner[group * lm.ROWS + before] * np.exp(h @ p["O"][group])
        want += np.log(g[group] / g.sum()) + np.log(i[inner] / i.sum()) + vocab.log_share(np.array([before]), np.array([to]))[0]
    return want / math.log(10)


def test_each_id_is_scored_once_with_its_own_past_only():
    vocab, model = small_model()
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 490, n) for n in (0, 1, lm.CHUNK - 1, lm.CHUNK, lm.CHUNK + 1, 40, 333)]
    ends = np.cumsum([len(d) for d in docs])
    together = lm.score_ids(model, np.concatenate(docs), ends)
    for d, got in zip(docs, together):
        assert abs(lm.score_ids(model, d, np.array([len(d)]))[0] - got) < 1e-3
        assert abs(plainly(model, vocab, d) - got) < 1e-3 * (1 + len(d) / 50)


def test_extreme_weights_stay_finite():
    vocab, model = small_model()
    for scale in (-1e4, 1e4):
        model.p["M"][:, : 2 * lm.WIDTH] = scale
        model.p["G"][:], model.p["O"][:] = -lm.MOST_OUT, lm.MOST_OUT
        assert np.isfinite(lm.score_ids(model, np.arange(300), np.array([300]))).all()


def test_gradients_by_differences():
    vocab, model = small_model()
    windows = lm.teaching_windows(vocab, np.random.default_rng(6).integers(0, 490, 120), np.array([40, 40, 120]))
    rows, first, klass, valid = windows
    near = lm.with_context(rows, 0)

    def loss():
        return -(model.log_class(near, first, klass).astype(float) * valid).sum() / valid.sum()

    grads = model.gradients(near, first, klass, valid)
    for key in model.SHAPES:
        at = np.unravel_index(np.argmax(np.abs(grads[key])), grads[key].shape)
        model.p[key][at] += 1e-2
        up = loss()
        model.p[key][at] -= 2e-2
        down = loss()
        model.p[key][at] += 1e-2
        assert grads[key][at] == pytest.approx((up - down) / 2e-2, rel=0.08, abs=2e-4), key


def test_every_id_and_end_teaches():
    vocab, _ = small_model()
    sizes = [0, 1, lm.CHUNK - 1, lm.CHUNK, 160, 333, 2000]
    ids = np.random.default_rng(7).integers(0, 490, sum(sizes))
    rows, first, klass, valid = lm.teaching_windows(vocab, ids, np.cumsum(sizes))
    assert len(rows) == sum(n // lm.CHUNK + 1 for n in sizes) and first.sum() == len(sizes)
    want = np.concatenate([[*d, vocab.end] for d in np.split(ids, np.cumsum(sizes)[:-1])]).astype(int)
    assert klass[valid].tolist() == vocab.klass[want].tolist()


def test_averages_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 3)
    rows = [(float(i + 1), (np.arange(4) * (i + 1.0)).astype("<f8").tobytes()) for i in range(20)]
    got = lm.averaged(spark.createDataFrame(rows, "weight double, flat binary").repartition(20), 20).collect()
    assert len(got) <= 3 and sum(r["weight"] for r in got) == 210
    assert np.allclose(sum(np.frombuffer(r["flat"], "<f8") for r in got), np.arange(4) * 210.0)


@pytest.mark.parametrize("n, block", [(2400, 100_000), (10_000, 500_000)])
def test_taught_score_beats_word_counts_on_held_out_texts(spark, monkeypatch, n, block):
    """At two sizes of the corpus, and with one block or many averaged ones."""
    monkeypatch.setattr(lexicon, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "PIECE_WORDS", 8000)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id") < n)
    got = lm.op1_lm_scores(docs, PATH).where("held_out AND n_tokens > 5").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    print(n, block, got["score"] / got["n"], got["base"] / got["n"])
    assert got["score"] > got["base"]
