"""Stateful limits as batch and as stream, against plain folds; specifications against Spark."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablescape.operators import events
from tablescape.plans import spec as plans
from tablescape.sources.catalog import FOREIGN_KEYS
from tablescape.streaming import limits

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows(n=120):
    rng, t, out = random.Random(4), datetime(2024, 1, 1), []
    for i in range(n):
        t += timedelta(seconds=rng.choice([0, 1, 30, 400, 5000]))
        out.append((i, t, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["error", "view"]), rng.random()))
    return out


def plain(machine, data, value=lambda r: 0.0):
    state, out = {}, {}
    for r in sorted(data, key=lambda r: (r[1], r[0])):
        s, said = machine.step(state.get(r[2], machine.start), r[1].timestamp(), value(r))
        state[r[2]] = s
        out[r[0]] = said
    return out


MACHINES = [(limits.Penalty(limit=2, window=900.0), None), (limits.Bucket(capacity=2.0, rate=0.01), None), (limits.Breaker(failures=2, rest=600.0), "breaker")]


@pytest.mark.parametrize("machine, kind", MACHINES)
def test_fold_equals_plain(spark, machine, kind):
    data = rows()
    value = F.when(F.col("event_type") == "error", -1.0).otherwise(1.0) if kind else None
    want = plain(machine, data, lambda r: -1.0 if r[3] == "error" else 1.0)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {r["event_id"]: tuple(r)[3:] for r in limits.fold(df, machine, "user_id", value).collect()}
    assert got == {i: pytest.approx(v) for i, v in want.items()}
    assert limits.fold(df.where("false"), machine, "user_id", value).count() == 0


def test_stream_equals_fold(spark, tmp_path):
    data = [r for r in rows() if r[2] is not None]
    cut = len(data) // 2
    for i, part in enumerate((data[:cut], data[cut:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    machine = limits.Penalty(limit=2, window=900.0)
    q = limits.stream(source, machine, "user_id").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = plain(machine, data)
    assert {r["event_id"]: tuple(r)[3:] for r in spark.sql("SELECT * FROM limited").collect()} == want


def test_windows_and_alerts(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["user_id"], r["ts"]): r["trailing"] for r in events.trailing_counts(df, ["user_id"], 3600).collect()}
    for r in data:
        assert got[r[2], r[1]] == sum(s[2] == r[2] and r[1] - timedelta(hours=1) < s[1] <= r[1] for s in data)
    all_ = events.alerts(df, "error", 3, 3600).collect()
    assert all(r["trailing"] >= 3 for r in all_)
    kept = events.purge(df, F.lit(data[-1][1]), 1).count()
    assert kept == sum(r[1] >= data[-1][1] - timedelta(days=1) for r in data)
    calls = limits.in_batches(spark.range(25), lambda xs: [x * 2 for x in xs], "id", "bigint").collect()
    assert all(r["result"] == 2 * r["id"] for r in calls)


def test_specifications(spark):
    path = plans.join_path("lineitem", "region", FOREIGN_KEYS)
    assert [j.right for j in path] == ["supplier", "nation", "region"] and plans.join_path("events", "region", FOREIGN_KEYS) == []
    c = plans.Condition
    spec = plans.QuerySpec(["a"], ["x"], conditions=[c("x", "IN", 1), c("y", "BETWEEN", "q'"), c("y", "LIKE", "q%")], order_by=[("x", "desc")], limit=0)
    df = spark.createDataFrame([(1, "q'"), (1, "z"), (2, "q'")], "x int, y string")
    assert [r["x"] for r in plans.execute(spec, {"a": df}).collect()] == [1]
    assert plans.to_sql(spec) == "SELECT a.x\nFROM a\nWHERE a.x IN (1) AND a.y = 'q''' AND a.y LIKE 'q%'\nORDER BY x DESC"
    assert plans.cost(spec) == (2 + 6 + 6, "medium") and plans.lint(spec) == ["an order without a limit sorts everything"]
    j = plans.Join("a", "x", "b", "z")
    assert plans.without_duplicate_joins(plans.QuerySpec(["a", "b"], joins=[j, plans.Join("b", "z", "a", "x")])).joins == [j]
    d = plans.from_description("revenue of lineitem per region", FOREIGN_KEYS, ["region", "lineitem"])
    assert set(d.tables) == {"region", "lineitem", "supplier", "nation"} and len(d.joins) == 3
    with pytest.raises(ValueError):
        plans.execute(plans.QuerySpec(["a", "b"]), {"a": df, "b": df})


def test_rolling_mean_of_large_keys_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else None if i % 7 == 0 else f"k{i % 5}", float(rng.randrange(100)) if i % 11 else None, rng.randrange(300)) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id int, k string, v double, t int").repartition(7)
    want = {}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[3], r[0]))
        for j, r in enumerate(own):
            last = [x[2] for x in own[max(0, j - 19) : j + 1] if x[2] is not None]
            want[r[0]] = sum(last) / len(last) if last else None
    for block in (1 << 16, 90, 10, 1):
        monkeypatch.setattr(events, "BLOCK", block)
        got = events.rolling_mean(df, "k", "v", ["t", "event_id"], rows=20)
        assert got.columns == [*df.columns, "rolling"]
        assert {r["event_id"]: r["rolling"] for r in got.collect()} == pytest.approx(want)
    assert events.rolling_mean(df.where("false"), "k", "v", ["t"]).count() == 0
