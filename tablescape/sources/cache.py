"""A cache of table vectors in files, as a data source that opens only what is fresh and tells what is damaged.

A file's name holds the key (quoted), the second it was written in and the
first half of its content's SHA-256, so age is known without opening it and
damage when it is read: ``<key>.<seconds>.<digest>.json``.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "key string, created_at timestamp, table_name string, embedding array<double>, problem string"
NAME = re.compile(r"(?P<key>.*)\.(?P<second>\d+)\.(?P<digest>[0-9a-f]{32})\.json")
#: Files of a task, and days for which an entry is fresh.
FILES, DAYS = 64, 7


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _second(value) -> float:
    return (value if value.tzinfo else value.replace(tzinfo=timezone.utc)).timestamp()


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    """Takes filters on ``created_at`` (from below) and ``key`` (equal), both answered by file names alone."""

    def __init__(self, path: str):
        self.path, self.since, self.after, self.key = path, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("created_at",):
                self.since = max(_second(f.value), self.since or 0)
            elif isinstance(f, GreaterThan) and f.attribute == ("created_at",):
                self.after = max(_second(f.value), self.after or 0)
            elif isinstance(f, EqualTo) and f.attribute == ("key",) and self.key is None:
                self.key = f.value
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        m = NAME.fullmatch(name)
        if not m:
            return False
        second = int(m["second"])
        return (self.since is None or second >= self.since) and (self.after is None or second > self.after) and (self.key is None or unquote(m["key"]) == self.key)

    def partitions(self) -> list[InputPartition]:
        fs, at = _open(self.path)
        found = fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.is_file and self._wanted(f.base_name))
        return [_Files(names[i : i + FILES]) for i in range(0, len(names), FILES)] or [_Files([])]

    def read(self, partition: _Files):
        fs, at = _open(self.path)
        for name in partition.names:
            m = NAME.fullmatch(name)
            with fs.open_input_stream(f"{at}/{name}") as f:
                body = f.read()
            table, vector, problem = None, None, None
            if hashlib.sha256(body).hexdigest()[:32] != m["digest"]:
                problem = "digest differs"
            else:
                try:
                    entry = json.loads(body)
                    table, vector = entry.get("tableName"), entry.get("embedding")
                    if not table or not isinstance(vector, list):
                        table, vector, problem = None, None, "no table name or embedding"
                    else:
                        vector = [float(v) for v in vector]
                except (ValueError, TypeError, AttributeError) as e:
                    table, vector, problem = None, None, f"not an entry: {type(e).__name__}"
            yield unquote(m["key"]), datetime.fromtimestamp(int(m["second"]), timezone.utc), table, vector, problem


class CacheDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def write_cache(vectors: DataFrame, path: str, at: datetime) -> int:
    """Write (key, table_name, embedding) as entries of the time ``at``, a file a row; how many. Null keys, names and vectors go."""
    second = int(_second(at))

    def run(batches):
        fs, home = _open(path)
        fs.create_dir(home)
        for batch in batches:
            for r in batch.to_pylist():
                body = json.dumps({"tableName": r["table_name"], "embedding": r["embedding"]}).encode()
                name = f"{quote(r['key'], safe='')}.{second}.{hashlib.sha256(body).hexdigest()[:32]}.json"
                part = f"{home}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(body)
                fs.move(part, f"{home}/{name}")  # seen whole or not at all; a task that runs again writes the same name
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = vectors.select("key", "table_name", "embedding").where("key IS NOT NULL AND table_name IS NOT NULL AND embedding IS NOT NULL").dropDuplicates(["key"])
    return rows.mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0


def read_cache(spark: SparkSession, path: str, since: datetime | None = None, key: str | None = None) -> DataFrame:
    """(key, created_at, table_name, embedding, problem): entries written from ``since`` on; older ones are not opened.

    A file whose content is not what its name says, or is no entry, gives a row
    with the problem named; other files are left alone. Switches Spark's
    push-down to Python sources on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CacheDataSource)
    found = spark.read.format("vector_cache").load(path)
    from pyspark.sql import functions as F

    if since is not None:
        found = found.where(F.col("created_at") >= F.lit(since))
    return found if key is None else found.where(F.col("key") == key)
