"""Terms of blocks of documents, and values that each distinct term gets once.

A block is some megabytes of consecutive rows of one task. Its row holds the
distinct terms once and each document's terms by their numbers in the block.
To give every term a value (a corpus count, a number of pieces), the blocks'
distinct terms are shuffled by term, valued once each, and shuffled back to
their block. What moves is a term for each block that has it, several times
fewer rows than a term for each document, and a term that stands everywhere
moves once a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.llm.common import arrow_schema, rows_of
from tablescape.session import stage

#: Bytes of text in a block, about.
BLOCK_BYTES = 24 << 20
#: Blocks' terms that one task values, about; blocks whose rows of one term may meet in a task; blocks that a task joins with their terms' values.
TASK_TERMS, TERM_BLOCKS, TASK_BLOCKS = 250_000, 4096, 8


class Numbers(dict):
    """Numbers new terms in the order in which they are looked up."""

    def __missing__(self, term):
        n = self[term] = len(self)
        return n


def blocks(docs: DataFrame, split: Callable[[bytes], list], flag: str | None = None, bags: bool = False) -> DataFrame:
    """The written table of blocks of ``docs`` (doc_id, text[, flag]).

    Columns: ``block`` (its name), ``doc_ids``, ``n_bytes``, ``flags`` (of the
    boolean column ``flag``), ``ends`` (int64: each document's end in
    ``codes``), ``codes`` (uint32: term numbers, zstd), ``freqs`` (uint32,
    zstd: with ``bags``, how often the document has the term; else codes are
    in the text's order), ``terms`` (binary, as ``split`` gives them) and
    ``weights`` (how often flagged documents have the term). ``split`` gets
    the UTF-8 bytes of a text. Null text counts as empty.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block string, doc_ids array<{id_type}>, n_bytes array<bigint>, flags array<boolean>, ends binary, codes binary, freqs binary, n_terms bigint, terms array<binary>, weights array<bigint>"
    wanted = arrow_schema(schema)

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        task, number = TaskContext.get().partitionId(), 0
        known = Numbers()
        keys, sizes, flags, codes, freqs, held = [], [], [], [], [], 0

        def row():
            all_codes = np.concatenate(codes) if codes else np.empty(0, np.uint32)
            all_freqs = np.concatenate(freqs) if freqs else np.empty(0, np.uint32)
            marked = np.repeat(np.array(flags, bool), [len(c) for c in codes])
            weights = np.bincount(all_codes[marked], weights=all_freqs[marked] if bags else None, minlength=len(known)).astype(np.int64)
            return pa.RecordBatch.from_pydict({
                "block": [f"{task}-{number}"], "doc_ids": [keys], "n_bytes": [sizes], "flags": [flags], "ends": [np.cumsum([len(c) for c in codes]).astype("<i8").tobytes()],
                "codes": [squeeze(all_codes.astype("<u4").tobytes())], "freqs": [squeeze(all_freqs.astype("<u4").tobytes())], "n_terms": [len(known)],
                "terms": pa.array([list(known)], pa.list_(pa.binary())), "weights": [weights],
            }, schema=wanted)

        for batch in rows_of(batches):
            marks = batch.column(2).to_pylist() if flag else [False] * batch.num_rows
            for key, text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), marks):
                terms = split(text) if text else []
                code = np.fromiter(map(known.__getitem__, terms), np.uint32, len(terms))
                if bags:
                    code, n = np.unique(code, return_counts=True)
                    freqs.append(n.astype(np.uint32))
                codes.append(code)
                keys.append(key)
                flags.append(bool(mark))
                sizes.append(len(text or b""))
                held += sizes[-1]
                if held >= BLOCK_BYTES:
                    yield row()
                    number += 1
                    known.clear()
                    keys, sizes, flags, codes, freqs, held = [], [], [], [], [], 0
        if keys:
            yield row()

    return stage(docs.select("doc_id", F.col("text").cast("binary").alias("text"), *([flag] if flag else [])).mapInArrow(run, schema), "blocks")


def valued(table: DataFrame, value: Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, list[bytes] | None, tuple[np.ndarray, np.ndarray] | None]], weighed: bool = False) -> DataFrame:
    """The written table (block, at, number, body, sizes) of the terms' values, some rows a block.

    ``value`` gets distinct terms, the sums of their weights over the whole
    corpus (if ``weighed``) and whether the term is seen here first, and gives
    a number a term, bytes a term or None, and a sparse vector (int32 indices,
    int64 values) or None that goes in a row of its own, with block null, for
    the whole corpus. A term is dealt to a task by its hash, and to several if
    there are more blocks than ``TERM_BLOCKS``: no task gets more rows of one
    term than that, and one of these tasks sees it first.
    """
    n, n_blocks = table.agg(F.coalesce(F.sum("n_terms"), F.lit(0)), F.count("*")).first()
    salts = max(1, -(-n_blocks // TERM_BLOCKS))
    # a block has a term once, so a term's rows are as many as blocks at most
    rows = table.select("block", F.posexplode(F.arrays_zip("terms", "weights")).alias("at", "t")).select("block", "at", F.col("t.terms").alias("term"), F.col("t.weights").alias("weight"))
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    if salts == 1:
        rows = rows.select("*", F.lit(0).alias("salt"), F.lit(True).alias("first"))
    elif weighed:
        rows = rows.withColumn("salt", salt)
        totals = rows.groupBy("term").agg(F.sum("weight").alias("total"), F.min("salt").alias("least"))  # combined before the shuffle
        rows = rows.join(totals, "term").select("block", "at", "term", F.col("total").alias("weight"), "salt", (F.col("salt") == F.col("least")).alias("first"))
    else:
        rows = rows.select("*", salt.alias("salt"), F.lit(True).alias("first"))
    sums = salts == 1
    schema = "block string, at binary, number binary, body binary, sizes binary"
    wanted = arrow_schema(schema)

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        coded = pa.compute.dictionary_encode(whole.column("term")).chunk(0)
        terms, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        weights = whole.column("weight").to_numpy()
        if sums:
            weight = np.bincount(code, weights=weights, minlength=len(terms)).astype(np.int64)
        else:
            weight = np.zeros(len(terms), np.int64)
            weight[code] = weights
        first = np.zeros(len(terms), bool)
        first[code[whole.column("first").to_numpy(zero_copy_only=False)]] = True
        number, body, vector = value(terms, weight, first)
        where = pa.compute.dictionary_encode(whole.column("block")).chunk(0)
        names, where, at = where.dictionary.to_pylist(), where.indices.to_numpy(zero_copy_only=False), whole.column("at").to_numpy()
        del whole, got
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(len(names) + 1))
        for i, name in enumerate(names):
            mine = order[cut[i] : cut[i + 1]]
            c = code[mine]
            parts = [body[x] for x in c] if body is not None else []
            yield pa.RecordBatch.from_pydict({
                "block": [name], "at": [at[mine].astype("<i4").tobytes()], "number": [number[c].astype("<i8").tobytes()],
                "body": [b"".join(parts)], "sizes": [np.fromiter(map(len, parts), "<i4", len(parts)).tobytes()],
            }, schema=wanted)
        if vector is not None:
            yield pa.RecordBatch.from_pydict({"block": [None], "at": [vector[0].astype("<i4").tobytes()], "number": [vector[1].astype("<i8").tobytes()], "body": [b""], "sizes": [b""]}, schema=wanted)

    dealt = rows.repartition(max(1, -(-n // TASK_TERMS)), "term", "salt").select("block", "at", "term", "weight", "first")
    return stage(dealt.mapInArrow(run, schema), "values")


def with_values(table: DataFrame, values: DataFrame) -> DataFrame:
    """Each block's row with ``parts``, the rows of its terms' values; a block a task, or ``TASK_BLOCKS`` if there are many."""
    n = table.count()
    tasks = max(1, min(n, 1024), n // TASK_BLOCKS)
    parts = values.where("block IS NOT NULL").repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("at", "number", "body", "sizes")).alias("parts"))
    return table.drop("terms", "weights").repartition(tasks, "block").join(parts, "block", "left")


def codes_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, freqs, ends) of a block's row."""
    import zstandard

    loose = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(loose(row["codes"]), "<u4"), np.frombuffer(loose(row["freqs"]), "<u4"), np.frombuffer(row["ends"], "<i8")


def numbers_of(row: dict) -> np.ndarray:
    """The number of each of the block's terms, by its place."""
    out = np.zeros(row["n_terms"], np.int64)
    for part in row["parts"] or []:
        out[np.frombuffer(part["at"], "<i4")] = np.frombuffer(part["number"], "<i8")
    return out
