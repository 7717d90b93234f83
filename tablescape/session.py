"""Sessions, the shared scratch folder, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "tablescape", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; a cluster's own settings win over nothing here."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests), where none is named, a temporary folder of
    this machine is set and used; executors elsewhere would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _staged(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_tablescape_staged"):
        spark._tablescape_staged = []
    return spark._tablescape_staged


def stage(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders by the columns ``by``, and read it back.

    Cuts the lineage: a lost executor costs a read of the written table and no
    recomputation, and rows that are used twice are computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    _staged(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, label: str, by: str, buckets: int) -> DataFrame:
    """Write ``df`` like ``stage``, in ``buckets`` by the column ``by``: tables so written meet on it without a shuffle.

    The session's catalog names the files only while they are written.
    """
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/staged/{label}-{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, by).saveAsTable(name)
    _staged(spark).append(path)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return found


class Buckets:
    """A table written piece by piece, all pieces in the same ``buckets`` by the column ``by``: rows of any pieces meet on it without a shuffle.

    The session's catalog names it until ``close``; the files stay like those of ``stage``.
    """

    def __init__(self, spark: SparkSession, label: str, by: str, buckets: int):
        self._spark, self._by, self._buckets, self._pieces = spark, by, buckets, 0
        self._name = f"staged_{uuid.uuid4().hex}"
        self._path = f"{shared_dir(spark)}/staged/{label}-{self._name}"

    def add(self, df: DataFrame) -> int:
        """Write ``df`` as the next piece; its number."""
        rows = df.withColumn("piece", F.lit(self._pieces))
        rows.write.format("parquet").option("compression", "zstd").option("path", self._path).partitionBy("piece").bucketBy(self._buckets, self._by).mode("append").saveAsTable(self._name)
        if not self._pieces:
            _staged(self._spark).append(self._path)
        self._pieces += 1
        return self._pieces - 1

    def read(self, *pieces: int) -> DataFrame:
        return self._spark.table(self._name).where(F.col("piece").isin(*pieces))

    def close(self) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {self._name}")


def merged(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join of two tables that both grow with the data, sorted and merged.

    Spark takes the size of a written table's files for that of its rows, and
    files of short rows are packed up to twenty times: below the threshold of
    broadcasts, they would pass whole through the driver.
    """
    return a.join(b.hint("merge"), on, how)


def staged_count(spark: SparkSession) -> int:
    """How many tables of this session ``stage`` wrote that are not released."""
    return len(_staged(spark))


def release_staged(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables that ``stage`` wrote in this session, from number ``since`` on but for the last ``keep``; results read from them are void afterwards."""
    paths, jvm = _staged(spark), spark.sparkContext._jvm
    gone = paths[since : len(paths) - keep]
    for path in gone:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    paths[since : len(paths) - keep] = []
    return len(gone)
