"""Commits are seen whole or not at all; the cache opens what is fresh and names what is damaged."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tablescape.sources import cache, sinks


def test_replacement_is_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    t, r = spark.range(3).toDF("t"), spark.range(4).toDF("r")
    read = lambda name, p="p/1": sorted(x[0] for x in sinks.read_table(spark, path, p, name).collect())
    assert sinks.replace_project(t, path, "p/1", r) == 1 and sinks.replace_project(spark.range(9), path, "p2") == 1
    assert read("rows") == [0, 1, 2] and read("relationships") == [0, 1, 2, 3]
    sinks.replace_tables({"relationships": r.where("r > 2")}, path, "p/1")  # one table alone
    assert read("rows") == [0, 1, 2] and read("relationships") == [3]
    sinks.replace_project(t.where("false"), path, "p/1")  # an empty replacement leaves no row
    assert read("rows") == [] and read("relationships") == [3] and read("rows", "p2") == list(range(9))
    with pytest.raises(ValueError):
        sinks.read_table(spark, path, "p3", "rows")
    with pytest.raises(ValueError):
        sinks.replace_tables({}, path, "p2")


def test_failed_and_torn_writes_leave_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    sinks.replace_project(spark.range(3), path, "p", spark.range(2))
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        sinks.replace_project(spark.range(100), path, "p", broken)
    assert sinks.read_project(spark, path, "p").count() == 3 and sinks.read_project(spark, path, "p", "relationships").count() == 2
    home = f"{path}/project_id=p"
    with open(f"{home}/manifest-000000000002.json", "w") as f:
        f.write("a torn manif")
    assert sinks.read_project(spark, path, "p").count() == 3
    assert sinks.replace_project(spark.range(6), path, "p") == 3
    seen = sinks._manifests(spark, path, "p")
    assert sinks.replace_project(spark.range(7), path, "p") == 4
    with monkeypatch.context() as stale, pytest.raises(Exception):  # as of before: its number is taken, nothing is overwritten in silence
        stale.setattr(sinks, "_manifests", lambda *a: seen)
        sinks.replace_project(spark.range(8), path, "p")
    assert sinks.remove_old(spark, path, "p") >= 4 and sinks.remove_old(spark, path, "p") == 0
    assert sinks.read_project(spark, path, "p").count() == 7 and sinks.read_project(spark, path, "p", "relationships").count() == 2


def test_domains_are_one_commit(spark, tmp_path):
    path = str(tmp_path / "store")
    d = spark.createDataFrame([("a", 0.12345), ("b", None)], "domain string, confidence double")
    m = spark.createDataFrame([("a", "t1"), ("a", None)], "domain string, table_name string")
    e = spark.createDataFrame([("t1", [0.5, 1.0])], "table_name string, embedding array<double>")
    assert sinks.store_domains(d, path, "p", m, e) == 1
    assert sorted(r["confidence"] for r in sinks.read_table(spark, path, "p", "domains").collect()) == ["0.000", "0.123"]
    assert [tuple(r) for r in sinks.read_table(spark, path, "p", "domain_tables").collect()] == [("a", "t1")]
    assert sinks.read_table(spark, path, "p", "embeddings").first()["embedding"] == "[0.5,1.0]"
    sinks.store_domains(d.where("domain = 'b'"), path, "p")
    assert sinks.read_table(spark, path, "p", "domain_tables").count() == 0 and sinks.read_table(spark, path, "p", "domains").count() == 1


def test_cache(spark, tmp_path):
    path, now = str(tmp_path / "cache"), datetime(2026, 1, 20, tzinfo=timezone.utc)
    rows = spark.createDataFrame([("a/b.c", "t1", [1.0, 2.0]), ("k2", "t2", []), (None, "t", [1.0]), ("k3", None, [1.0])], "key string, table_name string, embedding array<double>")
    assert cache.write_cache(rows, path, now) == 2
    assert cache.write_cache(rows.where("key = 'k2'").withColumn("key", F.lit("old")), path, now - timedelta(days=9)) == 1
    got = {r["key"]: r for r in cache.read_cache(spark, path).collect()}
    assert set(got) == {"a/b.c", "k2", "old"} and got["a/b.c"]["embedding"] == [1.0, 2.0] and all(r["problem"] is None for r in got.values())
    since = now - timedelta(days=cache.DAYS)
    # an expired file is not opened: it cannot be read at all here
    old = next(f for f in os.listdir(path) if f.startswith("old"))
    os.remove(f"{path}/{old}")
    os.symlink(f"{path}/nowhere", f"{path}/{old}")
    damaged = next(f for f in os.listdir(path) if f.startswith("k2"))
    with open(f"{path}/{damaged}", "a") as f:
        f.write(" ")
    with open(f"{path}/notes.txt", "w") as f:
        f.write("no entry")
    got = {r["key"]: r for r in cache.read_cache(spark, path, since).collect()}
    assert set(got) == {"a/b.c", "k2"} and got["k2"]["problem"] == "digest differs" and got["k2"]["embedding"] is None
    assert [r["key"] for r in cache.read_cache(spark, path, since, "a/b.c").collect()] == ["a/b.c"]
    assert cache.read_cache(spark, str(tmp_path / "none")).count() == 0
    reader = cache._Reader(path)
    kept = list(reader.pushFilters([cache.GreaterThanOrEqual(("created_at",), since), cache.EqualTo(("key",), "k2"), cache.EqualTo(("table_name",), "t2")]))
    assert len(kept) == 1 and [n for p in reader.partitions() for n in p.names] == [damaged]
