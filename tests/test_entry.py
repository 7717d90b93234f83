"""The entry points, and every query that has SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
OWN = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.7g}") if math.isfinite(float(v)) else None
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(plain(v.item() if hasattr(v, "item") else None if str(v) in ("<NA>", "NaT") else v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def test_flagship(spark):
    assert entry.entry(spark).columns == ["r_name", "cents", "n_lines"] and entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", OWN)
def test_equals_sql(spark, con, name):
    got, want = rows(entry.queries()[name](spark, DIR).toPandas()), rows(con.execute(entry.oracle_sql()[name]).df())
    assert got == want


def partition(pdf, clusters=None):
    """Every node once; with ``clusters`` as many of them at most."""
    return len(pdf) > 0 and pdf["node"].is_unique and (clusters is None or pdf["cluster"].nunique() <= clusters)


#: What must hold of the results of queries that SQL does not express; their values are tested with their operators.
INVARIANTS = {
    "hub_detection": lambda p: p["node"].is_unique,
    "hub_seeded_assignment": lambda p: partition(p) and (p[p.stage == 0].node == p[p.stage == 0].cluster).all() and set(p.cluster.dropna()) <= set(p[p.stage == 0].node),
    "consolidated_domains": partition,
    "structural_domains": lambda p: p["cluster"].is_unique and p["confidence"].between(0, 1).all(),
    "hub_affinity": lambda p: p["hub"].is_unique and ((p.affinity >= 0.7) == (p.strength == "strong")).all() and (p.affinity >= 0).all(),
    "label_propagation": lambda p: partition(p) and set(p.cluster) <= set(p.node),
    "spectral_clusters": lambda p: partition(p, 4) and p.cluster.nunique() > 1,
    "louvain_parts": lambda p: partition(p) and set(p.cluster) <= set(p.node) and p.cluster.nunique() < len(p),
    "linkage_parts": lambda p: p.b.is_unique and (p.a < p.b).all() and p.n.between(2, 25).all() and (p.height > 0).all(),
    "gap_embeddings": lambda p: list(p.k) == [1, 2, 4, 6, 8, 10, 12] and (p.within.diff().dropna() < 0).all() and (p.expected.diff().dropna() < 0).all() and (p.deviation > 0).all(),
    "cascade_embeddings": partition,
    "clustering_stability": lambda p: len(p) == 3 and p.ari.dropna().between(-1, 1).all() and p.nmi.dropna().between(-1e-9, 1 + 1e-9).all(),
    "kmeans_embeddings": lambda p: partition(p, 10),
    "hierarchical_embeddings": lambda p: partition(p, 10),
}


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"])
def test_invariants(spark, name):
    assert INVARIANTS[name](entry.queries()[name](spark, DIR).toPandas())
