"""Fill-in-middle transformation: texts are cut in two places and their parts reordered by a displacement scatter.

A batch's texts are one run of bytes. Its cuts make segments; a difference
array holds, where a segment begins, by how much its bytes move further than
those before them. The cumulative sum is every byte's shift; a scatter writes
all bytes of the batch to their places at once, and the inverse gather reads
them back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablescape.llm.common import rows_of, unused

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Per cent of texts that stay plain, and of the others those with the suffix first.
PLAIN, SPM = 10, 20
#: Bytes that are shifted at once: bounds memory however long a text is.
STEP = 1 << 20


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the ends of its values (from 0 on)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.empty(0, np.uint8), at - at[0]


def moved(source: np.ndarray, begin: np.ndarray, to: np.ndarray, out: np.ndarray, back: bool = False) -> None:
    """Move segments of ``source``, which begin at ``begin`` (ascending, from 0 on) and follow each other, to ``to`` in ``out``; with ``back`` read from ``to`` of ``source`` what goes to ``begin`` of ``out``."""
    begin, to = begin.astype(np.int64), to.astype(np.int64)
    total = len(out) if back else len(source)
    jump = np.diff(to - begin, prepend=0)
    for at in range(0, total, STEP):
        past = min(at + STEP, total)
        a, b = np.searchsorted(begin, (at, past), "left")
        difference = np.zeros(past - at, np.int64)
        np.add.at(difference, begin[a:b] - at, jump[a:b])  # empty segments begin where the next one does
        if a:
            difference[0] += to[a - 1] - begin[a - 1]
        place = np.cumsum(difference) + np.arange(at, past)
        if back:
            out[at:past] = source[place]
        else:
            out[place] = source[at:past]


def _strings(body: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary()).cast(pa.string(), safe=False)


def scattered(text: pa.Array, form: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The texts with prefix, middle and suffix in the order of ``form`` (0 plain, 1 psm, 2 spm), cut after ``low`` and ``high`` code points."""
    body, ends = _bytes(text)
    n, size = len(text), np.diff(ends)
    first = np.flatnonzero((body & 0xC0) != 0x80)  # where code points begin
    points = np.searchsorted(first, ends)
    first = np.append(first, len(body))
    cut = [np.where(form == 0, 0, np.minimum(first[np.minimum(points[:-1] + c, len(first) - 1)], ends[1:]) - ends[:-1]) for c in (low, high)]
    part = np.stack([cut[0], cut[1] - cut[0], size - cut[1]], 1)  # lengths of prefix, middle, suffix
    length = size + np.where(form == 0, 0, sum(map(len, MARKS)))
    out_ends = np.concatenate([[0], np.cumsum(length)])
    p, m, s = part.T
    # places of prefix, middle and suffix within the output, by form
    at = np.stack([np.where(form == 1, 3, np.where(form == 2, 6 + s, 0)), np.where(form == 1, 9 + p + s, np.where(form == 2, 9 + s + p, 0)), np.where(form == 1, 6 + p, np.where(form == 2, 3, 0))], 1)
    begin = ends[:-1, None] + np.stack([np.zeros(n, np.int64), p, p + m], 1)
    out = np.empty(int(out_ends[-1]), np.uint8)
    moved(body, begin.ravel(), (out_ends[:-1, None] + at).ravel(), out)
    for mark, before in zip(MARKS, (at[:, 0], at[:, 2], at[:, 1])):
        place = (out_ends[:-1] + before - len(mark))[form > 0]
        out[place[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    return _strings(out, out_ends)


def _found(body: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` stands in the bytes."""
    hit = np.ones(max(0, len(body) - len(mark) + 1), bool)
    for i, b in enumerate(mark):
        hit &= body[i : len(body) - len(mark) + 1 + i] == b
    return np.flatnonzero(hit)


def gathered(output: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts that ``scattered`` made ``output`` of, from the output and its form alone: a text that is not plain holds each mark once."""
    body, ends = _bytes(output)
    cut = form > 0
    mark = {}
    for m in MARKS:
        at = _found(body, m)
        mark[m] = ends[:-1].copy()
        mark[m][cut] = at[np.searchsorted(at, ends[:-1][cut])]
    p, s, m = (mark[x] + 3 for x in MARKS)
    stop = ends[1:]
    psm = form == 1
    span = np.stack([np.where(psm, s - 3, m - 3) - p, stop - m, np.where(psm, m - 3, p - 3) - s], 1)  # lengths of prefix, middle, suffix
    span[~cut] = 0
    span[~cut, 2] = np.diff(ends)[~cut]
    source = np.stack([p, m, s], 1)
    source[~cut] = ends[:-1][~cut][:, None]
    text_ends = np.concatenate([[0], np.cumsum(span.sum(1))])
    begin = text_ends[:-1, None] + np.stack([np.zeros(len(span), np.int64), span[:, 0], span[:, 0] + span[:, 1]], 1)
    out = np.empty(int(text_ends[-1]), np.uint8)
    moved(body, begin.ravel(), source.ravel(), out, back=True)
    return _strings(out, text_ends)


def plan(text: Column, doc_id: Column, seed: str = "1:") -> dict[str, Column]:
    """n, form, low and high of each text: its code points, its form and after how many code points it is cut.

    The numbers are the first 8-digit groups of the hex sha256 of the seed and
    the decimal id; a null id counts as none. The text is not null.
    """
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    n = F.length(text).cast("bigint")
    plain = (n == 0) | (h[2] % 100 >= 100 - PLAIN)
    for m in MARKS:
        plain = plain | F.contains(text, F.lit(m.decode()))
    return {
        "n": n, "form": F.when(plain, "plain").when(h[3] % 100 < SPM, "spm").otherwise("psm"),
        "low": F.when(~plain, F.least(h[0] % (n + 1), h[1] % (n + 1))), "high": F.when(~plain, F.greatest(h[0] % (n + 1), h[1] % (n + 1))),
    }


FORMS = {"plain": 0, "psm": 1, "spm": 2}


def _codes(forms: pa.Array) -> np.ndarray:
    return np.array([FORMS[f] for f in forms.to_pylist()], np.int64)


def _with_column(df: DataFrame, name: str, used: list[str], make) -> DataFrame:
    """``df`` with the string column ``name`` that ``make`` gives for a batch's ``used`` columns; all others pass through."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    wanted, at = to_arrow_schema(schema), [df.columns.index(c) for c in used]

    def run(batches):
        for batch in rows_of(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, make(*(batch.column(i) for i in at))], schema=wanted)

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = "1:") -> DataFrame:
    """``docs`` with fim_n (code points), fim_form, fim_low, fim_high (cuts after so many code points; null if plain) and fim_output, the transformed text.

    psm is prefix, suffix, middle; spm suffix, prefix, middle; each part after
    its mark. A text is plain, and its own output, if it is null (then empty)
    or empty, holds a mark, or is drawn so. Equal ids are cut alike; repeated
    rows stay; other columns stay, and a column that shares its name with a new
    one has underscores put after the new one's. Long texts are moved in steps
    of ``STEP`` bytes. No row meets another, so nothing is shuffled.
    """
    names = {n: unused(docs, f"fim_{n}") for n in ("n", "form", "low", "high", "output")}
    body = F.coalesce(F.col(text), F.lit(""))
    planned = docs.withColumns({names[k]: c for k, c in plan(body, F.col(doc_id), seed).items()})
    used = [text, names["form"], names["low"], names["high"]]

    def make(texts: pa.Array, forms: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        numbers = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in (low, high)]
        return scattered(texts.fill_null(""), _codes(forms), *numbers)

    return _with_column(planned, names["output"], used, make)


def restored(made: DataFrame, output: str = "fim_output", form: str = "fim_form", into: str = "fim_restored") -> DataFrame:
    """``made`` with the text rebuilt from ``output`` and ``form`` alone in the column ``into``; null outputs give empty texts."""
    return _with_column(made, into, [output, form], lambda out, forms: gathered(out.fill_null(""), _codes(forms.fill_null("plain"))))


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    """The contract's columns: the digests of the operator's outputs and of the texts rebuilt from them."""
    made = restored(fill_in_middle(docs.select("doc_id", "text")).drop("text"))
    return made.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_low").alias("prefix_chars"), (F.col("fim_high") - F.col("fim_low")).alias("middle_chars"),
        F.sha2(F.col("fim_output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("fim_restored").cast("binary"), 256).alias("restored_sha256"),
    )
