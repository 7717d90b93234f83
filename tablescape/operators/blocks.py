"""All rows against all rows: a block of rows is held in a task and all others pass by it.

A pair of rows is never shuffled, nor a pair of tiles: every row is sent once
to each block, so the shuffle is the table times the number of blocks, and a
task holds its block and the batch that passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.session import stage

#: Rows in a block at most, and blocks that a small table is dealt to, of ``FEWEST`` rows at least.
BLOCK, SPREAD, FEWEST = 8192, 24, 512


def vectors(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """An array column as a matrix of doubles, a row a vector."""
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def against_all(rows: DataFrame, held: Callable, schema: str, half: bool = False, block: int | None = None) -> DataFrame:
    """What ``held`` gives for every block of ``rows``.

    ``held(block, others)`` takes the block as a record batch of the columns of
    ``rows`` and the iterator of (record batch, own) that pass by it, in any
    order; ``own`` is true for batches of the block's own rows. With ``half``
    two blocks meet once, in one of them. It yields record batches of ``schema``.
    """
    rows = stage(rows, "blocks")
    count = rows.count()
    size = block or max(FEWEST, min(BLOCK, -(-count // SPREAD)))
    n = max(1, -(-count // size))
    names = rows.columns
    own = F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")
    # with half of the pairs, blocks meet those after them in a ring, so that all tasks have the same work
    if half:
        meets = F.filter(F.sequence(F.lit(0), F.lit(n // 2)), lambda o: (2 * o != n) | (own >= o)) if n > 1 else F.array(F.lit(0))
        to = F.transform(meets, lambda o: F.pmod(own - o, F.lit(n)))
    else:
        to = F.sequence(F.lit(0), F.lit(n - 1))
    # side 0 is the block itself, 1 its own rows once more, 2 all others
    passing = rows.select(F.explode(to).alias("_block"), own.alias("_own"), *names).select("_block", F.when(F.col("_block") == F.col("_own"), 1).otherwise(2).alias("_side"), *names)
    dealt = rows.select(own.alias("_block"), F.lit(0).alias("_side"), *names).unionByName(passing).repartitionByRange(n, "_block").sortWithinPartitions("_block", "_side")

    def runs(batches) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            if batch.num_rows:
                key = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    part = batch.slice(a, b - a)
                    yield int(key[a, 0]), int(key[a, 1]), pa.RecordBatch.from_arrays([part.column(i) for i in range(2, part.num_columns)], names)

    def run(batches):
        left = runs(batches)
        ahead = next(left, None)
        while ahead is not None:
            at, parts = ahead[0], []
            while ahead is not None and ahead[:2] == (at, 0):
                parts.append(ahead[2])
                ahead = next(left, None)

            def others():
                nonlocal ahead
                while ahead is not None and ahead[0] == at:
                    now, ahead = ahead, None
                    yield now[2], now[1] == 1
                    ahead = next(left, None)

            passes = others()
            yield from held(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], passes)
            for _ in passes:
                pass

    return dealt.mapInArrow(run, schema)
