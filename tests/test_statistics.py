"""Order statistics and percentiles by refining histograms against numpy, with one group of a third of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescape.functions import stats
from tablescape.sources import catalog


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = [("hot", float(v)) for v in rng.lognormal(sigma=3, size=4000)] + [(f"g{i % 40}", float(i % 17)) for i in range(7000)] + [(None, float(v)) for v in rng.integers(0, 5, 900)]
    out += [("hot", None), ("ties", None), ("one", -2.5)] + [("ties", 7.0)] * 500 + [("wide", v) for v in (-1e308, 1e308, 0.0, 1.0, float("inf"), float("-inf"))]
    return spark.createDataFrame(out, "k string, v double").repartition(5), out


def by_key(out):
    found = {}
    for k, v in out:
        found.setdefault(k, []).extend([] if v is None else [v])
    return {k: np.sort(v) for k, v in found.items()}


def test_order_statistics(spark, rows):
    df, out = rows
    want = by_key(out)
    ranks = [0, 1, 5, 99, 1333, 3999, 4000, -1]
    t = spark.createDataFrame([(k, r) for k in want if k is not None for r in ranks], "k string, rank int")
    for bins in (2, 1024):
        got = {(r["k"], r["rank"]): r["value"] for r in stats.order_statistics(df, "v", t, ["k"], bins=bins).collect()}
        assert got == {(k, r): v[r] for k, v in want.items() if k is not None for r in ranks if 0 <= r < len(v)}
    whole = np.sort([v for _, v in out if v is not None])
    assert stats.order_statistic(df, "v", 3000) == whole[2999] and stats.order_statistic(df, "v", 10**7) is None
    assert stats.order_statistic(df.where("false"), "v", 1) is None


@pytest.mark.parametrize("least", [1 << 16, 300, 0])
def test_percentiles(spark, rows, monkeypatch, least):
    df, out = rows
    monkeypatch.setattr(stats, "SORTED_ROWS", least)
    df = df.where("k IS NULL OR k <> 'wide'")
    want = {k: v for k, v in by_key(out).items() if k != "wide"}
    got = {r["k"]: r for r in stats.percentiles_linear(df, "v", [0.0, 0.5, 0.951, 1.0], ["k"]).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert [got[k][c] for c in ("p0", "p50", "p95", "p100")] == pytest.approx([np.percentile(v, p) for p in (0, 50, 95.1, 100)], rel=1e-12)
    got = {r["k"]: r for r in stats.percentiles_by_index(df, "v", [0, 25, 99, 100], ["k"]).collect()}
    for k, v in want.items():
        assert [got[k][f"p{p}"] for p in (0, 25, 99, 100)] == [v[len(v) * p // 100] if len(v) * p // 100 < len(v) else None for p in (0, 25, 99, 100)]
    one = stats.percentiles_linear(df.where("k = 'hot'"), "v", [0.333]).collect()
    assert len(one) == 1 and one[0][0] == pytest.approx(np.percentile(want["hot"], 33.3), rel=1e-12)
    assert stats.percentiles_by_index(df.where("k = 'hot'"), "v", [50]).first()[0] == want["hot"][2000]
    assert stats.percentiles_linear(df.where("false"), "v", [0.5], ["k"]).count() == 0


@pytest.mark.parametrize("word", [2, 63])
def test_discovered_keys_by_hand(spark, monkeypatch, word):
    """Sets of columns over one or several words: shares by brute force, nulls, repeats, negative values and columns of nulls alone."""
    monkeypatch.setattr(catalog, "WORD", word)
    held = {
        "a": ("id long, half int, gone long, note string", [(-1, 1, None, "x"), (2, 1, None, "y"), (3, 9, None, "z"), (1, None, None, None)]),
        "b": ("a_id long, id short", [(-1, 10), (2, 11), (2, 12), (7, 13)]),
        "c": ("id long, some long", [(1, 1), (9, 2), (10, None)]),
        "d": ("note string", [("1",)]),
    }
    tables = {t: spark.createDataFrame(rows, schema) for t, (schema, rows) in held.items()}
    columns = {(t, c.split()[0]): [r[i] for r in rows] for t, (schema, rows) in held.items() for i, c in enumerate(schema.split(", ")) if "string" not in c}
    for least in (0.3, 1.0):
        expected = {}
        for (st, sc), s in columns.items():
            for (tt, tc), d in columns.items():
                values = set(s) - {None}
                if st != tt and None not in d and len(set(d)) == len(d) and values & set(d) and len(values & set(d)) / len(values) >= least:
                    expected[st, sc, tt, tc] = pytest.approx(len(values & set(d)) / len(values))
        found = catalog.discover_keys(tables, least).collect()
        assert {tuple(r)[:4]: r["share"] for r in found} == expected and len(found) == len(expected) > 0
