"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages. Every passage of the whole text is encoded;
gated attention, learned from document labels alone, weighs the passages; the
weighted passage representation is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.llm.common import arrow_map, id_fold, unused
from tablescape.session import stage

#: Bytes of a passage.
PASSAGE = 512
#: Buckets of hashed byte pairs beside the 256 byte counts.
PAIRS = 256
#: Shares of a passage's words that equal the word before, and the one before that.
ECHOES = 2
FEATURES = 256 + PAIRS + ECHOES
HIDDEN, GATE = 24, 12
#: Labelled documents that the model learns from, at most: those of the smallest hash of their id; and passages of them, all together: whole documents in that order while they fit.
SAMPLE, MOST_PASSAGES = 10_000, 120_000
#: Documents of this score and above are accepted.
THRESHOLD = 0.3


_RANDOM = np.random.default_rng(99).integers(1, 1 << 40, 256)
_RANDOM[65:91] = _RANDOM[97:123]  # A-Z count as a-z


def echoes(x: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` passages the shares of words equal to the first and second word before them; ``x`` are bytes, ``row`` their passages."""
    inside = (x > 32) & (x != 127)
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    out = np.zeros((n, ECHOES), np.float32)
    if not len(first):
        return out
    at = np.flatnonzero(inside)
    word = np.cumsum(new)[at] - 1
    name = np.bincount(word, weights=((_RANDOM[x[at]] * (at - first[word] + 1)) % (1 << 31)).astype(np.float64), minlength=len(first))
    where = row[first]
    words = np.maximum(1, np.bincount(where, minlength=n))
    for k in range(1, ECHOES + 1):
        same = (name[k:] == name[:-k]) & (where[k:] == where[:-k])
        out[:, k - 1] = np.bincount(where[k:][same], minlength=n) / words
    return out


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, starts): square roots of byte and hashed byte-pair shares and the echoes of each passage, and each document's first passage.

    A text is cut every ``PASSAGE`` bytes; an empty or null text is one passage
    without bytes. Pairs do not span passages, so any part of a text can be
    encoded alone.
    """
    data = [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts]
    sizes = np.array([len(x) for x in data], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    n = int(counts.sum())
    out, echo = np.zeros((n, FEATURES), np.float32), np.zeros((n, ECHOES), np.float32)
    buf = np.frombuffer(b"".join(data), np.uint8)
    if len(buf):
        # one passage a row, padded: the last of each document is short
        length = np.zeros(n, np.int64)
        has = sizes > 0
        length[:] = PASSAGE
        last = starts + counts - 1
        length[last] = sizes - (counts - 1) * PASSAGE
        length[last[~has]] = 0
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        for at in range(0, n, 2048):  # bounded memory whatever the texts' length
            some = slice(at, min(n, at + 2048))
            a, b = int(begin[some][0]), int(begin[some][-1] + length[some][-1])
            x = buf[a:b].astype(np.int32)
            row = np.repeat(np.arange(some.stop - at, dtype=np.int32), length[some])
            one = np.bincount(row * 256 + x, minlength=(some.stop - at) * 256).reshape(-1, 256)
            same = row[1:] == row[:-1]
            pair = ((x[:-1] * 31 + x[1:] * 17) % PAIRS)[same]
            two = np.bincount(row[1:][same] * PAIRS + pair, minlength=(some.stop - at) * PAIRS).reshape(-1, PAIRS)
            out[some, :256] = one
            out[some, 256 : 256 + PAIRS] = two
            echo[some] = echoes(x, row, some.stop - at)
    total = np.maximum(1, out[:, :256].sum(1, keepdims=True))
    out = np.sqrt(out / total, dtype=np.float32)
    out[:, 256 + PAIRS :] = echo
    return out, starts


class BagModel:
    """Passage encoder, gated attention and document score; trained with Adam on the log loss."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {
            "W": init(FEATURES, HIDDEN) * 3, "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE, 1)[:, 0],
            "c": np.zeros(HIDDEN, np.float32), "d": np.zeros(1, np.float32),
        }

    def forward(self, x, starts):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -40, 40)))
        return score, (h, t, s, a, z, sizes)

    def score(self, x, starts) -> np.ndarray:
        return self.forward(x, starts)[0] if len(starts) else np.empty(0)

    def attention(self, x, starts) -> np.ndarray:
        """The weight of every passage in its document."""
        return self.forward(x, starts)[1][3]

    def gradients(self, x, starts, y):
        p = self.p
        score, (h, t, s, a, z, sizes) = self.forward(x, starts)
        g = ((score - y) / len(y)).astype(np.float32)
        dz = g[:, None] * p["c"]
        dzr = np.repeat(dz, sizes, axis=0)
        da = (dzr * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = a[:, None] * dzr + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - h * h)
        return {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 0.01, decay: float = 1e-3, seed: int = 0) -> "BagModel":
        """``bags`` are rounded features, 0 to 255, a row a passage."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, steps = 0, epochs * max(1, -(-len(bags) // batch))
        for _ in range(epochs if len(bags) else 0):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x = np.concatenate([bags[i] for i in some]).astype(np.float32) / np.float32(255)
                starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])[:-1]])
                step += 1
                lr = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
                for k, g in self.gradients(x, starts, labels[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * self.p[k])).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_passages: int = MOST_PASSAGES) -> BagModel:
    """A model fitted on ``sample`` labelled documents at most, none of them held out, with all their passages.

    The labels chosen are those of the smallest hash of their doc_id, a sample
    that depends on the ids alone; the join ships that bounded list to the
    documents. Of these documents the first in hash order teach whose passages
    are ``most_passages`` in all at most (the very first always), whole texts
    each: no text is cut. Their features come to the driver, a row a label: of
    repeated rows of a document those of the smallest features. Labels without
    an id or a quality are ignored; without labels or documents the model is
    its starting one; extra columns are ignored.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("float").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
        .where(id_fold(F.col("_id")) != 0).orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    )
    # ``sample`` rows of two numbers at most
    taught = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text")

    def make(batch):
        x, starts = passages(batch.column(2).to_pylist())
        bags = np.split(np.round(x * 255).astype(np.uint8), starts[1:])
        return {"doc_id": batch.column(0), "y": batch.column(1), "bag": pa.array([b.tobytes() for b in bags], pa.binary())}

    rows = arrow_map(taught, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y float, bag binary", most_bytes=1 << 20)
    rows = stage(rows.groupBy("doc_id", "y").agg(F.min("bag").alias("bag")), "bags")
    # ``sample`` rows of an id and a number at most
    sizes = rows.select("doc_id", "y", (F.length("bag") / FEATURES).cast("bigint").alias("n"), F.xxhash64("doc_id").alias("at"))
    order = Window.orderBy("at", "doc_id", "y")
    fit = sizes.select("doc_id", "y", F.sum("n").over(order).alias("until"), F.row_number().over(order).alias("rank")).where((F.col("until") <= most_passages) | (F.col("rank") == 1))
    found = rows.join(F.broadcast(fit.select("doc_id", "y")), ["doc_id", "y"]).collect()
    found.sort(key=lambda r: (r["doc_id"], r["y"]))
    bags = [np.frombuffer(r["bag"], np.uint8).reshape(-1, FEATURES) for r in found]
    return BagModel().fit(bags, np.array([r["y"] for r in found], np.float32))


def scored(docs: DataFrame, model: BagModel, column: str = "score") -> DataFrame:
    """``docs`` with all its columns and ``column``: the model's score of the whole text, 0 to 1.

    Null text counts as empty; repeated rows and null ids each keep their row;
    an empty table gives an empty result. ``column`` must be a new name.
    """
    own = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 60 kB, whatever the input
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{column}` double"])

    def make(batch):
        score = shared.value.score(*passages(batch.column(own.index("text")).to_pylist()))
        return {**{n: batch.column(i) for i, n in enumerate(own)}, column: pa.array(score.astype(float))}

    return arrow_map(docs, make, schema, most_bytes=1 << 20)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all columns, whatever their names.

    Null and empty texts are scored as empty ones; repeated rows share their
    fate; an empty table gives an empty result.
    """
    column = unused(docs, "quality_score")
    return scored(docs, train(docs, labels), column).where(F.col(column) >= THRESHOLD).drop(column)


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): every document; held out are ids whose crc32 as text is divisible by 5 (a null id, as empty text, too)."""
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", (id_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
