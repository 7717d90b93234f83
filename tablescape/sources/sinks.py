"""Sinks: a project's tables replaced together by one commit, domains stored with their scores, events appended.

A commit writes each table to a folder of its own and then one manifest, which
names the folders. What has no manifest does not exist to a reader, so a write
that fails midway leaves the state before it, and tables of a commit are seen
together or not at all.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _home(path: str, project_id: str) -> str:
    return f"{path}/project_id={quote(str(project_id), safe='')}"


def _manifests(spark: SparkSession, path: str, project_id: str) -> list[str]:
    """The project's manifests, oldest first."""
    fs, home = _fs(spark, _home(path, project_id))
    if not fs.exists(home):
        return []
    return sorted(f.getPath().toString() for f in fs.listStatus(home) if f.getPath().getName().startswith("manifest-"))


def manifest(spark: SparkSession, path: str, project_id: str) -> dict:
    """The newest whole manifest: {number, tables: {name: {folder, schema}}}; number 0 and no tables before the first commit."""
    for at in reversed(_manifests(spark, path, project_id)):
        line = spark.read.text(at, wholetext=True).first()
        digest, _, body = (line["value"] if line else "").partition("\n")
        if hashlib.sha256(body.encode()).hexdigest() == digest:  # else the writer stopped midway
            return json.loads(body)
    return {"number": 0, "tables": {}}


def replace_tables(tables: dict[str, DataFrame], path: str, project_id: str) -> int:
    """Make ``tables`` the project's tables of these names, all by one commit; its number. Tables that are not named stay.

    An empty table replaces the old rows by none. Without tables nothing is
    written. Two commits at once: the later one raises an error, as its number
    is taken; its folders are left to ``remove_old``.
    """
    if not tables:
        raise ValueError("no tables to replace")
    spark = next(iter(tables.values())).sparkSession
    now = manifest(spark, path, project_id)
    made = dict(now["tables"])
    for name, df in tables.items():
        folder = f"{_home(path, project_id)}/{quote(name, safe='')}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        made[name] = {"folder": folder.rsplit("/", 1)[1], "schema": df.schema.json()}
    taken = [int(m.rsplit("manifest-", 1)[1].split(".")[0]) for m in _manifests(spark, path, project_id)]
    number = max([now["number"], *taken]) + 1  # a torn manifest keeps its number
    body = json.dumps({"number": number, "tables": made})
    fs, target = _fs(spark, f"{_home(path, project_id)}/manifest-{number:012d}.json")
    out = fs.create(target, False)  # raises where the number is taken
    try:
        out.write(bytearray(f"{hashlib.sha256(body.encode()).hexdigest()}\n{body}".encode()))
    finally:
        out.close()
    return number


def read_table(spark: SparkSession, path: str, project_id: str, name: str) -> DataFrame:
    """The project's table as of the newest commit; a table that was never written raises an error."""
    found = manifest(spark, path, project_id)["tables"].get(name)
    if found is None:
        raise ValueError(f"project {project_id} has no table {name}")
    return spark.read.schema(T.StructType.fromJson(json.loads(found["schema"]))).parquet(f"{_home(path, project_id)}/{found['folder']}")


def remove_old(spark: SparkSession, path: str, project_id: str) -> int:
    """Delete the folders and manifests that the newest commit does not need; how many. Not while others read or write."""
    now = manifest(spark, path, project_id)
    keep = {t["folder"] for t in now["tables"].values()} | {f"manifest-{now['number']:012d}.json"}
    fs, home = _fs(spark, _home(path, project_id))
    gone = [f.getPath() for f in fs.listStatus(home) if f.getPath().getName() not in keep and not f.getPath().getName().startswith(".")] if fs.exists(home) else []
    for g in gone:
        fs.delete(g, True)
    return len(gone)


def replace_project(df: DataFrame, path: str, project_id: str, relationships: DataFrame | None = None) -> int:
    """Replace the project's rows, and with ``relationships`` these in the same commit; other projects' rows stay."""
    return replace_tables({"rows": df} | ({} if relationships is None else {"relationships": relationships}), path, project_id)


def read_project(spark: SparkSession, path: str, project_id: str, name: str = "rows") -> DataFrame:
    """The project's rows; only its folder is read."""
    return read_table(spark, path, project_id, name)


def store_domains(domains: DataFrame, path: str, project_id: str, members: DataFrame | None = None, embeddings: DataFrame | None = None) -> int:
    """Domains with their confidence as text of three decimals (null: 0.000), their tables and the tables' embeddings as JSON, all by one commit.

    Rows of ``members`` without a ``table_name`` go. What is not given is
    stored empty, as the domains before are cleared as a whole.
    """
    spark = domains.sparkSession
    none = lambda ddl: spark.createDataFrame([], ddl)
    members = none("domain string, table_name string") if members is None else members.where("table_name IS NOT NULL")
    embeddings = none("table_name string, embedding string") if embeddings is None else embeddings.withColumn("embedding", F.to_json("embedding"))
    return replace_tables({"domains": domains.withColumn("confidence", F.format_string("%.3f", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))), "domain_tables": members, "embeddings": embeddings}, path, project_id)


def append_events(events: DataFrame, path: str) -> None:
    """Append by day, so that retention drops whole folders."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def fresh(cache: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Cached rows not older than ``days``."""
    return cache.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
