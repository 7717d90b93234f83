"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescape.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it if ``df`` has a column of this name (Spark's names do not know case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(df: DataFrame, tag: str) -> DataFrame:
    """``df`` with a column ``tag`` that tells rows apart, equal ones too, and names them alike at every read, however a scan is split.

    A row that is read from a file as it stands is named by the file (128 bits
    of digests of its path) and its place there. Rows of any other table are
    numbered and written once.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        at = df.metadataColumn("_metadata")
        path = at["file_path"]
        return df.withColumn(tag, F.struct(F.xxhash64(path).alias("file"), F.xxhash64(F.reverse(path), F.length(path)).alias("also"), at["row_index"].alias("row")))
    none = F.lit(0).cast("bigint")
    return stage(df.withColumn(tag, F.struct(none.alias("file"), none.alias("also"), F.monotonically_increasing_id().alias("row"))), "tagged")


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; bytes.lower() and bytes.split() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``most_bytes`` at most (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n:
            step = max(1, int(n * most_bytes / max(batch.nbytes, most_bytes)))
            for at in range(0, n, step):
                yield batch.slice(at, step)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; for the driver, which hands it to the tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str, most_bytes: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns; column order and types follow ``schema``."""
    wanted = arrow_schema(schema)

    def run(batches):
        for batch in rows_of(batches, most_bytes):
            cols = make(batch)
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in wanted], schema=wanted)

    return df.mapInArrow(run, schema)


def id_fold(doc_id: F.Column, folds: int = 5) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
