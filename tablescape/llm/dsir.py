"""Importance resampling towards a target distribution, by hashed n-grams.

A batch's texts go through Arrow kernels: lower case, split at what is no
word, flatten, encode as a dictionary. Shifted dictionary indices form the
n-grams; each distinct pair (an n-gram and the word after it) is hashed once,
its checksum carried on from the shorter n-gram's. The buckets are written once;
counts and gains are then taken from them and summed over a document's segment.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.llm.common import arrow_schema, rows_of
from tablescape.session import stage

#: Fixed by the contract: what separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in the longest n-gram; buckets; words that a document needs to be drawn; per cent of documents drawn.
WIDTH, BUCKETS, LEAST_WORDS, PER_CENT = 3, 10_000, 20, 5
#: Bytes of text that are worked on at once, about: more only where one text is longer.
BATCH_BYTES = 8 << 20
#: Bytes of the longest word whose way for a checksum is kept as a table.
LONG = 64


@lru_cache(4096)
def _carried(length: int) -> np.ndarray:
    """How a CRC-32 moves on over ``length`` bytes, whatever they are: 4 x 256 words, of which the register's four bytes pick those that sum to it."""
    zeros = bytes(length)
    return np.array([[zlib.crc32(zeros, b << 8 * k) ^ zlib.crc32(zeros) for b in range(256)] for k in range(4)], np.uint32)


def carried_on(crc: np.ndarray, names: list[bytes], crc_of: np.ndarray, word: np.ndarray) -> np.ndarray:
    """zlib.crc32(names[w], c) of each pair of a checksum and a word's number, without a call a pair: the checksum is carried over the word's length."""
    size = np.array([len(w) for w in names])
    lengths, which = np.unique(size, return_inverse=True)
    short = lengths <= LONG
    tables = np.stack([_carried(int(n)) for n in lengths[short]]) if short.any() else np.zeros((1, 4, 256), np.uint32)
    row = which[word]
    plain = row < short.sum()
    out = crc_of[word].copy()
    for k in range(4):
        out[plain] ^= tables[row[plain], k, (crc[plain] >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(~plain):
        out[i] = zlib.crc32(names[word[i]], int(crc[i]))
    return out


def _type(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def ngram_buckets(texts: pa.Array, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, buckets of all n-grams text by text, ends of the texts' n-grams)."""
    body = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_binary()).fill_null(b"")  # copied, as kernels misread a slice's bytes
    split = pc.split_pattern_regex(pc.ascii_lower(body.cast(pa.large_string(), safe=False)).cast(pa.large_binary()), SEPARATORS)
    flat = pc.list_flatten(split)
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    flat, owner = flat.filter(pa.array(real)), owner[real]
    n_words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    number = [np.maximum(n_words - k, 0) for k in range(width)]  # of n-grams of k + 1 words
    ends = np.concatenate([[0], np.cumsum(sum(number))])
    out = np.empty(ends[-1], _type(buckets))
    if not len(flat):
        return n_words, out, ends
    coded = flat.dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = [b" " + w for w in coded.dictionary.to_pylist()]
    crc, crc_of = (np.array([zlib.crc32(w[at:]) for w in names], np.uint32) for at in (1, 0))
    index, place = word, ends[:-1].copy()
    for k, n in enumerate(number):
        if k:
            # each distinct pair of the shorter n-gram and the word after it is hashed once
            after = word[k:]
            pair = pa.array(index[: len(after)] * len(names) + after).dictionary_encode()
            first, last = np.divmod(pair.dictionary.to_numpy(), len(names))
            crc = carried_on(crc[first], names, crc_of, last)
            index = pair.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        within = owner[: len(index)] == owner[k:]  # both ends are of one text
        at = np.repeat(place - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[at] = (crc % np.uint32(buckets)).astype(out.dtype)[index[within]]
        place += n
    return n_words, out, ends


def _binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * flat.itemsize).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _flat(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    column, kind = column.cast(pa.large_binary()), _type(buckets)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8)[at[0] : at[-1]].view(kind) if body is not None else np.empty(0, kind), (at - at[0]) // kind.itemsize


def features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, grams) as a written table: the bucket of every n-gram of every document, packed in two bytes (four above 65,536 buckets)."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words bigint, grams binary"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BATCH_BYTES):
            n_words, flat, ends = ngram_buckets(batch.column(1), width, buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), _binaries(flat, ends)], schema=wanted)

    return stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema), "grams")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often n-grams of each bucket stand in all texts; a task gives a row a bucket at most."""
    wanted = arrow_schema("bucket int, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for batch in rows_of(batches, BATCH_BYTES):
            out += np.bincount(_flat(batch.column(0), buckets)[0], minlength=buckets)
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(out[used])], schema=wanted)

    return found.select("grams").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """A bucket's gain: 1000 times the log ratio of its smoothed shares in the target and in the raw texts, rounded down."""
    s_all, t_all = sum(raw.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (s_all + buckets) / ((raw.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)]


def weighed(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): every document with the sum of its n-grams' gains.

    The gains are those of all texts of ``docs`` against all of ``target``: a
    number a bucket comes to the driver and goes to the tasks. Null and empty
    texts have no n-grams and weigh 0; null ids and repeated rows stay; empty
    tables count as no n-grams. Extra columns are ignored.
    """
    of_docs, of_target = features(docs, text, doc_id, width, buckets), features(target.select(target_text, F.lit(0).alias("_id")), target_text, "_id", width, buckets)
    raw, aim = ({r["bucket"]: r["n"] for r in bucket_counts(d, buckets).collect()} for d in (of_docs, of_target))
    gains = np.array(gains_of(raw, aim, buckets), np.int64)
    schema = f"doc_id {of_docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BATCH_BYTES):
            flat, ends = _flat(batch.column(2), buckets)
            total = np.diff(np.concatenate([[0], np.cumsum(np.take(gains, flat))])[ends])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends)), pa.array(total)], schema=wanted)

    return of_docs.mapInArrow(run, schema)


def ranked(rows: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """``rows`` with ``rank``, 1 for the first in ``order``; by ranges, so no task holds more than a range.

    ``rows`` is a written table with columns that make the order whole. The
    ranges are written before they are counted; a number a range comes to the
    driver.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    dealt = stage(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["range"], r["n"]) for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect())
    before, start = [], 0
    for r, n in sizes:
        before.append((r, start))
        start += n
    starts = spark.createDataFrame(before, "range int, start bigint")
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("rank", within.cast("bigint")).join(F.broadcast(starts), "range").withColumn("rank", F.col("rank") + F.col("start")).drop("range", "start")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: str = "42:", text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document; those drawn have a rank, from 1 on.

    The score is the weight plus Gumbel noise (1000 times, rounded down) of the
    id, so the highest scores are a draw without replacement in proportion to
    the exponential weights. Of the documents with ``least_words`` words at
    least, ``per_cent`` of their number are drawn, ties to the smaller id. A
    null id counts as no text for its noise and comes after all others among
    ties; equal rows are ranked in any order. An empty table gives an empty
    result.
    """
    rows = weighed(docs, target, text, doc_id, target_text)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stage(rows.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = per_cent * able.count() // 100
    # of equal scores a range may hold very many: the written row number tells equal rows apart
    found = ranked(able.select("row", "score", F.col("doc_id").alias("id")), [F.desc("score"), F.col("id").asc_nulls_last(), F.col("row")])
    top = found.where(F.col("rank") <= drawn).select("row", "rank")
    return scored.join(top, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op11_resample(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns; every document, drawn or not."""
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
