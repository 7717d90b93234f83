"""Language-model scoring: causal self-attention over subword ids, trained and run in numpy.

The next subword is predicted by its class and its share within the class:
``p(id | context) = p(class | context) * p(id | class, id before)``. Classes are
frequent ids of their own and bands of rarer ones; shares are counts over the
whole training corpus. The class comes from one causal self-attention layer
over the last subwords and a hidden layer, by group and then within its group
(a softmax of two levels); its scores multiply the counted probability of the
class after the id before. The attention reads embeddings that are singular
vectors of counts, of the whole training corpus, of which classes stand one,
two and three places after an id; its weights are learned by gradients on
every window of every training document.

Contexts are overlapping windows of two chunks: the later chunk's ids are
scored, each with the earlier chunk and what precedes it in its own, so every
id is scored once. Windows are scored in batches with one masked attention.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.llm import lexicon
from tablescape.llm.common import arrow_schema, id_fold, rows_of
from tablescape.llm.tokenids import encoder
from tablescape.session import stage

#: Ids in a chunk; a window is two chunks.
CHUNK = 8
#: Width of embeddings, of queries and keys, of values and the hidden layer; groups of classes and classes of a group; rows of the embedding and pair tables.
DEPTH, WIDTH, HIDDEN, GROUPS, INNER, ROWS = 24, 4, 8, 16, 8, 2048
CLASSES = GROUPS * INNER
#: Places after an id whose classes are counted for its embedding.
LAGS = 3
#: Windows in a training step and in a scoring batch; steps that a small table's first round takes at least (passing over its windows again).
STEP_WINDOWS, LEAST_STEPS = 512, 200
#: Rounds of teaching: in each the tasks go on from the average of the round before, on windows that no other round has.
ROUNDS = 4
#: Words of the documents in a row of the table of ids, about.
PIECE_WORDS = 60_000
#: Models averaged in one task; parts of the vector of counts, each summed by a task.
FAN_IN, SLICES = 32, 64
#: Bounds of hidden values and of output weights: scores stay within +-40, so no exponent overflows or vanishes.
MOST_HIDDEN, MOST_OUT = 4.0, 1.25


class Vocabulary:
    """Classes, rows, embeddings and counted shares of the ids, from counts over the whole training corpus.

    Ids of rank below ``ROWS`` - 1 have a row of their own, the others share
    the last. ``cells`` is the vector of all pair counts (row of the id before,
    row) and, for each lag, counts (row, class that stands so many places
    later). Within a class an id's share is its count
    after the id before, smoothed by its count alone (Witten-Bell); so is the
    class itself, which is what the attention's scores multiply. Ids without
    an own row divide what their shared row has by their counts.
    """

    def __init__(self, counts: np.ndarray, begin: int, end: int, cells: np.ndarray | None = None):
        n, own, rare = len(counts), CLASSES * 5 // 8, min(ROWS - 1, len(counts))
        self.rare = rare
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        smooth = counts + 0.5
        rest = np.cumsum(smooth[order[own:]])
        self.klass = np.empty(n, np.int64)
        self.klass[order[:own]] = np.arange(min(own, n))
        if own < n:
            self.klass[order[own:]] = own + np.minimum((rest / rest[-1] * (CLASSES - own)).astype(int), CLASSES - own - 1)
        self.row = np.minimum(rank, rare)
        self.begin, self.end = begin, end
        if cells is None:
            return
        pairs, later = cells[: ROWS * ROWS].reshape(ROWS, ROWS)[:, :rare], cells[ROWS * ROWS :].reshape(LAGS, ROWS, CLASSES).astype(np.float64)
        embedding, placed = _embedding(later)
        new = np.empty(CLASSES, np.int64)  # classes that follow the same ids share a group
        new[placed] = np.arange(CLASSES)
        self.klass, after = new[self.klass], later[0][:, placed]
        self.embedding = embedding
        mass = np.bincount(self.klass, weights=smooth, minlength=CLASSES)
        share, prior = smooth / mass[self.klass], mass / mass.sum()
        self.share = np.log(share).astype(np.float32)
        some = np.maximum(1, (after > 0).sum(1, keepdims=True))
        class_of_row = self.klass[order[:rare]]
        in_class = [np.flatnonzero(class_of_row == k) for k in range(CLASSES)]
        known = np.stack([pairs[:, at].sum(1) for at in in_class], 1)
        kinds = np.maximum(0.5, np.stack([(pairs[:, at] > 0).sum(1) for at in in_class], 1) + (after > known))
        rare_share = np.maximum(1e-9, 1 - np.array([share[order[at]].sum() for at in in_class]))
        #: log share in its class of an id without an own row, but for its own share
        self.back = np.log(((after - known) / rare_share + kinds) / (after + kinds)).astype(np.float32)
        #: log share in its class of an id with an own row
        self.after = np.empty((ROWS, rare), np.float32)
        for k, at in enumerate(in_class):
            self.after[:, at] = np.log((pairs[:, at] + kinds[:, k, None] * share[order[at]]) / (after[:, k, None] + kinds[:, k, None]))
        start = ((after + some * prior) / (after.sum(1, keepdims=True) + some)).reshape(ROWS, GROUPS, INNER)
        #: probability of each group, and of each class within its group, after a row
        self.groups = start.sum(2).astype(np.float32)
        self.inner = np.ascontiguousarray((start / start.sum(2, keepdims=True)).transpose(1, 0, 2)).reshape(GROUPS * ROWS, INNER).astype(np.float32)

    def log_share(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log p(id | its class, the id before); ``before`` are rows."""
        row, rare = self.row[ids], self.rare
        return np.where(row < rare, self.after[before, np.minimum(row, rare - 1)], self.back[before, self.klass[ids]] + self.share[ids])


def _embedding(later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ROWS, DEPTH) embeddings, and the classes ordered by the ids that they follow."""
    parts = []
    for counts in later:
        total = counts.sum(1, keepdims=True)
        prior = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * CLASSES)
        parts.append(((counts + 20 * prior) / (total + 20) - prior) / np.sqrt(prior))
    z, weight = np.concatenate(parts, 1), np.sqrt((later[0].sum(1) + 1e-3) / (later[0].sum() + 1))[:, None]
    axes = np.linalg.svd(weight * z, full_matrices=False)[2]
    axes *= np.sign(axes.sum(1, keepdims=True) + 1e-12)
    found = z @ axes[:DEPTH].T
    found /= np.sqrt(((weight * found) ** 2).sum(0)) + 1e-6
    return (0.7 * np.clip(found, -5, 5)).astype(np.float32), np.argsort(axes[0, :CLASSES], kind="stable")


SEEN = (np.arange(2 * CHUNK)[None, :] <= CHUNK + np.arange(CHUNK)[:, None]).astype(np.float32)


class Attention:
    """The network over a vocabulary's embeddings; its weights are float32 and flatten to one vector.

    ``M`` maps an embedding to its query, key, value and own hidden values,
    ``B`` are attention scores by place, ``G`` and ``O`` score the groups and
    the classes of each group.
    """

    SHAPES = {"M": (DEPTH, 2 * WIDTH + 2 * HIDDEN), "b": (HIDDEN,), "B": (CHUNK, 2 * CHUNK), "G": (HIDDEN, GROUPS), "O": (GROUPS, HIDDEN, INNER)}

    def __init__(self, vocab: Vocabulary, seed: int = 0):
        self.vocab, self._held = vocab, {}
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(size=s) * 0.1 / np.sqrt(HIDDEN)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.p["M"] = rng.normal(size=self.SHAPES["M"]).astype(np.float32) / np.float32(np.sqrt(DEPTH))
        self.p["M"][:, : 2 * WIDTH] *= WIDTH**-0.25
        self.p["b"][:], self.p["B"][:] = 0.5, 0

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def load(self, flat: np.ndarray) -> "Attention":
        at = 0
        for k, s in self.SHAPES.items():
            self.p[k] = np.array(flat[at : at + int(np.prod(s))], np.float32).reshape(s)
            at += int(np.prod(s))
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each row query, key, value, own hidden values and embedding, side by side: a window is one look-up; and the attention by place."""
        t = self.vocab.embedding @ self.p["M"]
        t[:, 2 * WIDTH + HIDDEN :] += self.p["b"]
        return np.concatenate([t, self.vocab.embedding], 1), np.exp(self.p["B"]) * SEEN

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array of this shape that later calls overwrite: batches reuse their memory."""
        n = int(np.prod(shape))
        if name not in self._held or len(self._held[name]) < n:
            self._held[name] = np.empty(n, np.float32)
        return self._held[name][:n].reshape(shape)

    def _windows(self, x: np.ndarray, n: int) -> np.ndarray:
        """(n, 2 chunks, width): every chunk with the one before it, without copies."""
        step, width = x.strides
        return as_strided(x, (n, 2 * CHUNK, x.shape[1]), (CHUNK * step, step, width))

    def _hidden(self, rows: np.ndarray, first: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """The hidden layer at each place of ``rows``' chunks but the first chunk, which is context only; ``first`` marks chunks without a predecessor.

        Attention scores are held within 60 of 0 and every place sees itself,
        so no sum of exponents is 0 or too large.
        """
        n, room, w = len(rows) - 1, self._room, WIDTH
        seen = np.take(tables[0], rows.ravel(), axis=0, mode="clip", out=room("seen", rows.size, tables[0].shape[1]))
        q, k = seen[CHUNK:, :w], self._windows(seen[:, w : 2 * w], n)
        v = self._windows(seen[:, 2 * w : 2 * w + HIDDEN], n)
        q = as_strided(q, (n, CHUNK, w), (CHUNK * q.strides[0], *q.strides))
        turned = room("turned", n, w, 2 * CHUNK)
        turned[...] = k.transpose(0, 2, 1)
        a = np.matmul(q, turned, out=room("a", n, CHUNK, 2 * CHUNK))
        np.exp(np.clip(a, -60, 60, out=a), out=a)
        a *= tables[1]
        a[first, :, :CHUNK] = 0
        wide = a.reshape(-1, 2 * CHUNK)
        scale = (1 / (wide @ np.ones(2 * CHUNK, np.float32)))[:, None]
        o = np.matmul(a, v, out=room("o", n, CHUNK, HIDDEN)).reshape(-1, HIDDEN)
        o *= scale
        h = np.add(o, seen[CHUNK:, 2 * w + HIDDEN : 2 * w + 2 * HIDDEN], out=room("h", n * CHUNK, HIDDEN))
        return np.clip(h, 0, MOST_HIDDEN, out=h), seen, q, k, v, a, scale, o

    def _levels(self, h: np.ndarray, before: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, ...]:
        """Unscaled probabilities of the groups, and of the classes of each place's own group, places sorted by group."""
        room, n = self._room, len(h)
        group = klass // INNER
        order = np.argsort(group.astype(np.uint8), kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])
        zg = np.exp(np.matmul(h, self.p["G"], out=room("zg", n, GROUPS)), out=room("zg", n, GROUPS))
        zg *= np.take(self.vocab.groups, before, axis=0, mode="clip", out=room("pg", n, GROUPS))
        hs, zi = np.take(h, order, axis=0, mode="clip", out=room("hs", n, HIDDEN)), room("zi", n, INNER)
        for g in range(GROUPS):
            np.matmul(hs[cut[g] : cut[g + 1]], self.p["O"][g], out=zi[cut[g] : cut[g + 1]])
        np.exp(zi, out=zi)
        zi *= np.take(self.vocab.inner, (group * ROWS + before)[order], axis=0, mode="clip", out=room("pi", n, INNER))
        at_group, at_inner = np.arange(0, n * GROUPS, GROUPS) + group, np.arange(0, n * INNER, INNER) + (klass % INNER)[order]
        return zg, zi, hs, order, cut, at_group, at_inner, zg @ np.ones(GROUPS, np.float32), zi @ np.ones(INNER, np.float32)

    def log_class(self, rows: np.ndarray, first: np.ndarray, klass: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Log probability of one class at each place of the chunks after the first."""
        h = self._hidden(rows, first, self.tables() if tables is None else tables)[0]
        zg, zi, _, order, _, at_group, at_inner, all_group, all_inner = self._levels(h, rows[1:].ravel(), klass.ravel())
        own = np.empty(len(order), np.float32)
        own[order] = zi.ravel()[at_inner] / all_inner
        own *= zg.ravel()[at_group] / all_group
        return np.log(own, out=own).reshape(klass.shape)

    def gradients(self, rows: np.ndarray, first: np.ndarray, klass: np.ndarray, valid: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """Of the mean log loss over the valid places of the chunks after the first."""
        h, seen, q, k, v, a, scale, o = self._hidden(rows, first, self.tables() if tables is None else tables)
        n, m, w, room, turn = len(rows) - 1, len(h), WIDTH, self._room, lambda x: x.transpose(0, 2, 1)
        zg, zi, hs, order, cut, at_group, at_inner, all_group, all_inner = self._levels(h, rows[1:].ravel(), klass.ravel())
        some = valid.ravel().astype(np.float32)
        zg *= (some / all_group)[:, None]
        zg.ravel()[at_group] -= some
        zi *= (some[order] / all_inner)[:, None]
        zi.ravel()[at_inner] -= some[order]
        dg, do, dhs = h.T @ zg, np.empty(self.SHAPES["O"], np.float32), room("dhs", m, HIDDEN)
        for g in range(GROUPS):
            mine = slice(cut[g], cut[g + 1])
            do[g] = hs[mine].T @ zi[mine]
            np.matmul(zi[mine], self.p["O"][g].T, out=dhs[mine])
        dh = np.matmul(zg, self.p["G"].T, out=room("dh", m, HIDDEN))
        hs[order] = dhs
        dh += hs
        dh *= (h > 0) & (h < MOST_HIDDEN)
        a.reshape(-1, 2 * CHUNK)[...] *= scale
        deep = dh.reshape(n, CHUNK, HIDDEN)
        turned = room("turned_v", n, HIDDEN, 2 * CHUNK)
        turned[...] = turn(v)
        da = np.matmul(deep, turned, out=room("da", n, CHUNK, 2 * CHUNK))
        da -= np.einsum("ij,ij->i", dh, o).reshape(n, CHUNK, 1)
        da *= a
        dq = np.matmul(da, k, out=room("dq", n, CHUNK, w))
        dk, dv = room("dk", m + CHUNK, w), room("dv", m + CHUNK, HIDDEN)
        dk[:CHUNK], dv[:CHUNK] = 0, 0
        np.matmul(turn(da[:, :, CHUNK:]), q, out=dk[CHUNK:].reshape(n, CHUNK, w))
        np.matmul(turn(a[:, :, CHUNK:]), deep, out=dv[CHUNK:].reshape(n, CHUNK, HIDDEN))
        dk[:-CHUNK] += np.matmul(turn(da[:, :, :CHUNK]), q, out=room("dk_before", n, CHUNK, w)).reshape(-1, w)
        dv[:-CHUNK] += np.matmul(turn(a[:, :, :CHUNK]), deep, out=room("dv_before", n, CHUNK, HIDDEN)).reshape(-1, HIDDEN)
        x = np.ascontiguousarray(seen[:, 2 * w + 2 * HIDDEN :])
        dm = np.concatenate([x[CHUNK:].T @ dq.reshape(-1, w), x.T @ dk, x.T @ dv, x[CHUNK:].T @ dh], 1)
        part = np.float32(1 / max(1, some.sum()))
        return {"M": dm * part, "b": dh.sum(0) * part, "B": da.sum(0) * part, "G": dg * part, "O": do * part}


class Learner:
    """Adam over consecutive windows, from a model on, at ``rate`` after some smaller steps."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.done = model, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))

    def learn(self, rows: np.ndarray, first: np.ndarray, klass: np.ndarray, valid: np.ndarray, least: int = 1) -> None:
        """One pass over all windows in a seeded order of steps, and more until ``least`` steps are done."""
        p, cuts = self.model.p, np.arange(0, len(rows), STEP_WINDOWS)
        for _ in range(max(1, -(-least // max(1, len(cuts))))):
            for at in np.random.default_rng(self.done).permutation(cuts):
                some = slice(at, at + STEP_WINDOWS)
                self.done += 1
                now = self.rate * min(1, self.done / 20)
                for k, g in self.model.gradients(with_context(rows, at), first[some], klass[some], valid[some]).items():
                    self.m[k] += np.float32(0.1) * (g - self.m[k])
                    self.v[k] += np.float32(0.01) * (g * g - self.v[k])
                    p[k] = p[k] - np.float32(now / (1 - 0.9**self.done)) * self.m[k] / (np.sqrt(self.v[k] / np.float32(1 - 0.99**self.done)) + np.float32(1e-8))
                for k in "GO":
                    np.clip(p[k], -MOST_OUT, MOST_OUT, out=p[k])


def with_context(rows: np.ndarray, at: int) -> np.ndarray:
    """``STEP_WINDOWS`` chunks from ``at`` on with the chunk before them; the very first stands in for its own, which is masked."""
    return rows[at - 1 : at + STEP_WINDOWS] if at else np.concatenate([rows[:1], rows[:STEP_WINDOWS]])


def chunked(ids: np.ndarray, ends: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """(inputs, targets, valid, first, doc): the documents' ids as chunks; each document starts after ``begin`` and is ended by ``end``."""
    sizes = np.diff(np.concatenate([[0], ends])) + 1
    chunks = -(-sizes // CHUNK)
    starts = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    n = int(chunks.sum())
    inputs, targets = np.full(n * CHUNK, vocab.begin, np.int64), np.full(n * CHUNK, vocab.end, np.int64)
    place = np.repeat(starts * CHUNK - np.concatenate([[0], ends])[:-1], sizes - 1) + np.arange(len(ids))
    targets[place] = ids
    inputs[place + 1] = ids
    valid = np.ones(n * CHUNK, bool)
    for past in range(1, CHUNK):  # places after a document's end in its last chunk
        some = sizes % CHUNK == CHUNK - past
        valid[((starts + chunks)[some] * CHUNK)[:, None] - np.arange(1, past + 1)] = False
    first = np.zeros(n, bool)
    first[starts] = True
    return inputs.reshape(n, CHUNK), targets.reshape(n, CHUNK), valid.reshape(n, CHUNK), first, np.repeat(np.arange(len(sizes)), chunks)


def score_ids(model: Attention, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 probability of each document's ids and its end."""
    vocab = model.vocab
    inputs, targets, valid, first, doc = chunked(ids, ends, vocab)
    rows, klass, tables, out = np.take(vocab.row, inputs), np.take(vocab.klass, targets), model.tables(), np.zeros(len(ends))
    for at in range(0, len(rows), STEP_WINDOWS):
        some = slice(at, at + STEP_WINDOWS)
        logs = model.log_class(with_context(rows, at), first[some], klass[some], tables) + vocab.log_share(rows[some], targets[some])
        out += np.bincount(doc[some], weights=(logs * valid[some]).sum(1, dtype=np.float64), minlength=len(ends))
    return out / np.log(10)


def teaching_windows(vocab: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rows, first, classes, valid) of every window of the documents."""
    inputs, targets, valid, first, _ = chunked(ids, ends, vocab)
    return np.take(vocab.row, inputs), first, np.take(vocab.klass, targets), valid


def cells_of(vocab: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places, in the vector of ``Vocabulary``'s ``cells``, of all that the documents count."""
    inputs, targets, valid, _, doc = chunked(ids, ends, vocab)
    rows, klass, valid, doc = np.take(vocab.row, inputs).ravel(), np.take(vocab.klass, targets).ravel(), valid.ravel(), np.repeat(doc, CHUNK)
    found = [(rows * ROWS + np.take(vocab.row, targets).ravel())[valid]]
    for lag in range(LAGS):
        have = len(rows) - lag
        cell = (ROWS * ROWS + lag * ROWS * CLASSES) + rows[:have] * CLASSES + klass[lag:]
        found.append(cell[valid[lag:] & (doc[:have] == doc[lag:])])
    return np.concatenate(found)


#: Counts in the vector of ``Vocabulary``, and in a slice of it.
CELLS = ROWS * ROWS + LAGS * ROWS * CLASSES
SLICE = -(-CELLS // SLICES)


def counted(seen: np.ndarray | None, cells: list[np.ndarray]) -> np.ndarray:
    """``seen`` and the counts of ``cells``."""
    found = np.bincount(np.concatenate(cells), minlength=CELLS)
    return found if seen is None else np.add(seen, found, out=seen)


def summed(slices: DataFrame) -> np.ndarray:
    """The vector of counts from the tasks' (slice, cells, counts): every slice is summed in a task and comes to the driver packed, ``SLICES`` rows."""

    def run(batches):
        import zstandard

        sums: dict[int, np.ndarray] = {}
        for batch in rows_of(batches):
            for number, at, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums.setdefault(number, np.zeros(SLICE, np.int64))[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
        for number, x in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": [number], "packed": [zstandard.compress(x.tobytes())]}, schema=pa.schema([("slice", pa.int32()), ("packed", pa.binary())]))

    import zstandard

    out = np.zeros(SLICE * SLICES, np.float32)
    for r in slices.repartition(SLICES, "slice").mapInArrow(run, "slice int, packed binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(zstandard.decompress(r["packed"]), np.int64)
    return out[:CELLS]


class BlockIds:
    """The subword ids of a block's documents, some documents at a time."""

    def __init__(self, row: dict, kind: str):
        n, width = row["n_terms"], np.dtype(kind).itemsize
        self.codes, _, self.ends = lexicon.codes_of(row)
        self.size, self.start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        bodies, at = [], 0
        for part in row["parts"] or []:
            place, size = np.frombuffer(part["at"], "<i4"), np.frombuffer(part["sizes"], "<i4") // width
            self.size[place] = size
            self.start[place] = at + np.cumsum(size) - size
            bodies.append(part["body"])
            at += int(size.sum())
        self.ids = np.frombuffer(b"".join(bodies), kind)

    def groups(self, words: int):
        """(first document, past document, ids, ends)."""
        begins, a = np.concatenate([[0], self.ends[:-1]]), 0
        while a < len(self.ends):
            b = max(a + 1, int(np.searchsorted(self.ends, begins[a] + words, "right")))
            code = self.codes[begins[a] : self.ends[b - 1]]
            size = self.size[code]
            run = np.cumsum(size)
            at = np.repeat(self.start[code] - run + size, size) + np.arange(run[-1] if len(run) else 0)
            yield a, b, self.ids[at], np.concatenate([[0], run])[self.ends[a:b] - begins[a]]
            a = b


MODEL = pa.schema([("weight", pa.float64()), ("flat", pa.binary())])


def averaged(models: DataFrame, n: int) -> DataFrame:
    """(weight, flat): the weighted sums of models' vectors, ``FAN_IN`` rows at most; merged in a tree of tasks."""

    def merge(batches):
        total, weight = None, 0.0
        for batch in rows_of(batches):
            for w, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = (0 if total is None else total) + np.frombuffer(f, "<f8")
                weight += w
        if total is not None:
            yield pa.RecordBatch.from_pydict({"weight": [weight], "flat": [total.astype("<f8").tobytes()]}, schema=MODEL)

    while n > FAN_IN:
        n = -(-n // FAN_IN)
        models = models.repartition(n).mapInArrow(merge, "weight double, flat binary")
    return models


def taught(pieces: DataFrame, per_round: dict[int, int], vocab) -> Attention:
    """A model taught on all windows of the marked documents of ``pieces`` (turn, flags, ends, ids).

    In round ``r`` of ``ROUNDS`` every task goes on from the average of the
    models of the round before, on its rows of turn ``r``, at a falling rate;
    the averages are weighted by ids. ``per_round`` are the rows of each turn,
    ``vocab`` is the broadcast vocabulary.
    """
    model = Attention(vocab.value)
    for r in range(ROUNDS):
        if not per_round.get(r):
            continue
        flat, rate, least = model.flat(), 0.01 * (1 - r / ROUNDS), -(-LEAST_STEPS // per_round[r])

        def teach(batches, flat=flat, rate=rate, least=least):
            learner, weight = Learner(Attention(vocab.value).load(flat), rate), 0.0
            for batch in rows_of(batches, 1):
                flags, ends, ids, kind = (batch.column(i)[0].as_py() for i in range(4))
                flags, ends, ids = np.array(flags, bool), np.frombuffer(ends, "<i8"), np.frombuffer(ids, kind)
                if flags.any():
                    sizes = np.diff(np.concatenate([[0], ends]))
                    windows = teaching_windows(vocab.value, ids[np.repeat(flags, sizes)], np.cumsum(sizes[flags]))
                    learner.learn(*windows, least)
                    weight += float(windows[3].sum())
            if weight:
                yield pa.RecordBatch.from_pydict({"weight": [weight], "flat": [(learner.model.flat().astype("<f8") * weight).tobytes()]}, schema=MODEL)

        found = averaged(pieces.where(F.col("turn") == r).select("flags", "ends", "ids", "kind").mapInArrow(teach, "weight double, flat binary"), per_round[r]).collect()
        if found:
            model.load(sum(np.frombuffer(m["flat"], "<f8") for m in found) / sum(m["weight"] for m in found))
    return model


def score_documents(docs: DataFrame, path: str, training: F.Column, text: str = "text", doc_id: str = "doc_id", begin: str = "<|startoftext|>", end: str = "<|endoftext|>") -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score, n_ids): every whole text, by a model of the rows ``training`` holds for.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and an end.
    ``base_score`` is their smoothed unigram log10 probability; ``score`` the
    attention model's log10 probability of the text's subword ids (``path``, a
    tokenizers file with the tokens ``begin`` and ``end``) and end. A word that
    the tokenizer drops is one begin id. Null text counts as empty: the end
    alone. Without training rows all counts are 0 and the model is its
    starting one. Repeated rows and null ids stay; extra columns are ignored;
    an empty table gives an empty result.
    """
    from tokenizers import Tokenizer

    spark, tokenizer = docs.sparkSession, Tokenizer.from_file(path)
    width, begin, end = tokenizer.get_vocab_size(), tokenizer.token_to_id(begin), tokenizer.token_to_id(end)
    kind = "<u2" if width <= 1 << 16 else "<u4"
    dropped = np.array([begin], kind).tobytes()
    table = lexicon.blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training")), lambda x: x.lower().split(), flag="training")

    def value(terms, weight, first):
        known = np.zeros(width + 2, np.int64)
        form = kind[1:].replace("u2", "H").replace("u4", "I")
        bodies = [struct.pack(f"<{len(x)}{form}", *x) if x else dropped for x in encoder(path).distinct(terms)]
        own = np.where(first, weight, 0)
        known[:width] = np.bincount(np.frombuffer(b"".join(bodies), kind), weights=np.repeat(own, [len(b) // np.dtype(kind).itemsize for b in bodies]), minlength=width)
        known[width], known[width + 1] = (own > 0).sum(), own.sum()
        at = np.flatnonzero(known)
        return weight, bodies, (at, known[at])

    values = lexicon.valued(table, value, weighed=True)

    def numbers(batches):
        for batch in rows_of(batches):
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict({"id": np.frombuffer(at, "<i4"), "n": np.frombuffer(n, "<i8")}, schema=pa.schema([("id", pa.int32()), ("n", pa.int64())]))

    # a row an id of the vocabulary and two totals, whatever the input
    got = values.where("block IS NULL").select("at", "number").mapInArrow(numbers, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    full = np.zeros(width + 2, np.int64)
    full[[r["id"] for r in got]] = [r["n"] for r in got]
    marked = table.agg(F.coalesce(F.sum(F.size(F.filter("flags", lambda x: x))), F.lit(0))).first()[0]
    distinct, total = int(full[width]) + (marked > 0), int(full[width + 1]) + int(marked)
    id_counts = full[:width].copy()
    id_counts[[begin, end]] += marked
    floor = float(np.log10(total + 0.5 * (distinct + 1)))
    plain = spark.sparkContext.broadcast(Vocabulary(id_counts, begin, end))
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"turn int, doc_ids array<{id_type}>, flags array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, ends binary, ids binary, kind string, slice int, cells binary, counts binary"
    wanted = arrow_schema(schema)

    def expand(batches):
        """A row for some documents of a block with their ids and word scores, and one a slice for all that a task's training documents count, with turn -1."""
        turn, seen, held = TaskContext.get().partitionId(), None, []
        for batch in rows_of(batches, 1):
            row = batch.to_pylist()[0]
            block, count, flags = BlockIds(row, kind), lexicon.numbers_of(row), np.array(row["flags"], bool)
            sums = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[block.ends]]))
            n = np.diff(np.concatenate([[0], block.ends])) + 1
            base = sums(np.log10(count + 0.5)[block.codes]) + np.log10(marked + 0.5) - n * floor
            known = sums(count[block.codes] > 0) + int(marked > 0)
            for a, b, ids, ends in block.groups(PIECE_WORDS):
                if flags[a:b].any():
                    sizes = np.diff(np.concatenate([[0], ends]))
                    cells = cells_of(plain.value, ids[np.repeat(flags[a:b], sizes)], np.cumsum(sizes[flags[a:b]]))
                    held.append(cells)
                    if sum(map(len, held)) >= CELLS:
                        seen, held = counted(seen, held), []
                yield pa.RecordBatch.from_pydict({
                    "turn": [turn % ROUNDS], "doc_ids": [row["doc_ids"][a:b]], "flags": [row["flags"][a:b]], "n_tokens": [n[a:b]], "n_known": [known[a:b]], "base": [base[a:b]],
                    "ends": [ends.astype("<i8").tobytes()], "ids": [ids.tobytes()], "kind": [kind], "slice": [None], "cells": [None], "counts": [None],
                }, schema=wanted)
                turn += 1
        seen = counted(seen, held) if held else seen
        for number in range(SLICES if seen is not None else 0):
            part = seen[number * SLICE : (number + 1) * SLICE]
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_pydict({**{f.name: [None] for f in wanted}, "turn": [-1], "slice": [number], "cells": [at.astype("<i4").tobytes()], "counts": [part[at].astype("<i8").tobytes()]}, schema=wanted)

    used = ["doc_ids", "flags", "ends", "codes", "freqs", "n_terms", "parts"]
    whole = stage(lexicon.with_values(table, values).select(*used).mapInArrow(expand, schema), "lm-ids", by=("turn",))
    vocab = spark.sparkContext.broadcast(Vocabulary(id_counts, begin, end, summed(whole.where("turn = -1").select("slice", "cells", "counts"))))
    pieces = whole.where("turn >= 0")
    model = taught(pieces, {r["turn"]: r["count"] for r in pieces.groupBy("turn").count().collect()}, vocab).flat()  # some 2,700 weights
    out = f"doc_id {id_type}, training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_ids bigint"
    scored = arrow_schema(out)

    def score(batches):
        net = Attention(vocab.value).load(model)
        for batch in rows_of(batches, 1):
            row = batch.to_pylist()[0]
            ends = np.frombuffer(row["ends"], "<i8")
            yield pa.RecordBatch.from_pydict({
                "doc_id": row["doc_ids"], "training": row["flags"], "n_tokens": row["n_tokens"], "n_known": row["n_known"], "train_tokens": [total] * len(ends),
                "base_score": row["base"], "score": score_ids(net, np.frombuffer(row["ids"], row["kind"]), ends), "n_ids": np.diff(np.concatenate([[0], ends])),
            }, schema=scored)

    return pieces.drop("turn", "slice", "cells", "counts").mapInArrow(score, out)


def op1_lm_scores(docs: DataFrame, path: str) -> DataFrame:
    found = score_documents(docs, path, id_fold(F.col("doc_id")) != 1)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
