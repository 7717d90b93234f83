"""Written tables, the shared folder and statistics on small inputs."""

import pytest
from pyspark.sql import functions as F

from tablescape.functions import stats
from tablescape.operators import hubs
from tablescape.session import release_staged, shared_dir, stage


def test_staged_tables(spark):
    df = stage(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert df.agg(F.sum("x")).first()[0] == 90 and shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    empty = stage(spark.range(0), "e")
    assert empty.count() == 0 and empty.columns == ["id"]
    assert release_staged(spark) >= 2 and release_staged(spark) == 0


def test_statistics(spark):
    df = spark.createDataFrame([(4.0,), (1.0,), (2.0,), (2.0,), (9.0,), (7.0,), (None,)], "v double")
    r = stats.percentiles_by_index(df, "v", [0, 25, 50, 90]).first()
    assert tuple(r) == (1.0, 2.0, 4.0, 9.0)
    assert stats.percentiles_linear(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), "v", [0.85]).first()[0] == pytest.approx(3.4)
    w = stats.weight_statistics(df.withColumn("v", F.col("v") / 10), F.col("v")).first()
    assert (w["n"], w["very_low"], w["low"], w["medium"], w["high"], w["very_high"]) == (6, 1, 2, 1, 1, 1)


def test_hub_types(spark):
    cols = spark.createDataFrame([("j", 4, 3, 1, False), ("m", 25, 1, 1, True), ("l", 3, 0, 1, False)], "node string, n_columns int, n_fk int, n_pk int, has_time boolean")
    con = spark.createDataFrame([("j", 0.9, "many-to-many")] + [("m", 0.9, "one-to-many")] * 16 + [("l", 0.9, "one-to-many")] * 12, "node string, weight double, kind string")
    got = {r["node"]: (r["hub_type"], r["is_hub"]) for r in hubs.hub_type(cols, con).collect()}
    assert got == {"j": ("junction", True), "m": ("master", True), "l": ("lookup", True)}


def test_normalised_by_component(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 3.0), ("x", "y", 10.0), ("y", "z", 30.0), ("z", "x", 20.0)], "src string, dst string, weight double")
    w = {(r["src"], r["dst"]): r["weight"] for r in hubs.normalised(e, component=True).collect()}
    assert w["a", "b"] == pytest.approx(0.1) and w["b", "c"] == pytest.approx(1.0) and w["z", "x"] == pytest.approx(0.55)
    assert hubs.canonical(e).count() == 5
