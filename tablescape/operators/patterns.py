"""Schema-pattern detectors over catalog columns and relationships.

``columns``: (table_name, column_name, type_class, is_pk, is_fk, is_unique);
``rels``: (source_table, source_column, target_table, target_column).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that make an audit trail, and columns of a lookup table.
AUDIT = ["createdat", "updatedat", "createdby", "modifiedby", "lastmodifiedby", "lastmodifiedon"]
LOOKUP = ["name", "label", "code", "value", "description", "type"]
# Importance of the keywords in a table's name.
IMPORTANCE = {
    "user": 0.9, "customer": 0.9, "account": 0.9, "order": 0.9, "product": 0.9, "service": 0.9, "campaign": 0.9, "project": 0.9,
    "transaction": 0.8, "payment": 0.8, "invoice": 0.8, "booking": 0.8, "reservation": 0.8, "subscription": 0.8, "contract": 0.8,
    "profile": 0.7, "settings": 0.6, "preference": 0.6, "notification": 0.5, "log": 0.4, "audit": 0.4, "history": 0.4,
    "type": 0.3, "status": 0.3, "category": 0.3, "template": 0.3, "config": 0.2, "metadata": 0.2,
}


def has(c: Column, *words: str) -> Column:
    """Whether a name contains any of the words, in any case."""
    return F.lower(c).rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def importance(name: Column) -> Column:
    """The greatest weight of the keywords in the name over a base of 0.5, times 0.3 for utility names, held to 0.1 to 1."""
    weights = sorted({w for w in IMPORTANCE.values() if w > 0.5}, reverse=True)
    best = F.coalesce(*[F.when(has(name, *[k for k, v in IMPORTANCE.items() if v == w]), w) for w in weights], F.lit(0.5))
    utility = has(name, "temp", "cache", "queue") | F.lower(name).startswith("sys_") | F.lower(name).startswith("tmp_")
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), best * F.when(utility, 0.3).otherwise(1.0)))  # best once: a method of twice the size is not compiled


def _stem(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "s$", "")


def _composed(source: Column, target: Column) -> Column:
    return F.lower(source).contains(_stem(target)) | F.lower(target).contains(_stem(source))


def relationship_kind(source: Column, target: Column) -> Column:
    """inheritance, composition, aggregation or association, by names."""
    return (
        F.when(has(source, "base", "parent") | has(target, "base", "parent"), "inheritance")
        .when(_composed(source, target), "composition")
        .when(has(source, "user", "customer") | has(target, "profile", "settings"), "aggregation")
        .otherwise("association")
    )


def relationship_strength(source: Column, target: Column) -> Column:
    s = F.lit(0.5) + F.when(_composed(source, target), 0.3).otherwise(0.0) + (importance(source) + importance(target)) * 0.1 - F.when(has(target, "type", "status", "category"), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), s))


def business_nature(source: Column, target: Column) -> Column:
    """core, lookup, audit, metadata or supporting."""
    return (
        F.when((importance(source) >= 0.7) & (importance(target) >= 0.7), "core")
        .when(has(target, "type", "status", "category", "lookup") | F.lower(target).endswith("_ref"), "lookup")
        .when(has(target, "log", "audit", "history") | has(source, "log", "audit"), "audit")
        .when(has(target, "config", "setting", "metadata", "template"), "metadata")
        .otherwise("supporting")
    )


def table_features(columns: DataFrame, rels: DataFrame) -> DataFrame:
    """(table_name, n_columns, n_fk, n_pk, n_non_key, has_unique, n_audit, has_parent, has_lookup_name, n_out, n_in, n_self)."""
    c = F.col("column_name")
    t = columns.groupBy("table_name").agg(
        F.count("*").alias("n_columns"), F.count_if("is_fk").alias("n_fk"), F.count_if("is_pk").alias("n_pk"), F.count_if(~F.col("is_fk") & ~F.col("is_pk")).alias("n_non_key"),
        F.coalesce(F.bool_or("is_unique"), F.lit(False)).alias("has_unique"), F.count_if(has(c, *AUDIT)).alias("n_audit"), F.bool_or(has(c, "parent")).alias("has_parent"), F.bool_or(has(c, *LOOKUP)).alias("has_lookup_name"),
    )
    out = rels.groupBy(F.col("source_table").alias("table_name")).agg(F.count("*").alias("n_out"), F.count_if(F.col("source_table") == F.col("target_table")).alias("n_self"))
    into = rels.groupBy(F.col("target_table").alias("table_name")).agg(F.count("*").alias("n_in"))
    return t.join(out, "table_name", "left").join(into, "table_name", "left").na.fill(0, ["n_out", "n_in", "n_self"])


def schema_patterns(columns: DataFrame, rels: DataFrame) -> DataFrame:
    """(table_name, pattern): junction, audit_trail, hierarchy, lookup, orphan; a table can have several."""
    f = table_features(columns, rels)
    found = {
        "junction": (F.col("n_fk") >= 2) & (F.col("n_columns") <= 6) & (F.col("n_out") >= 2),
        "audit_trail": F.col("n_audit") >= 2,
        "hierarchy": (F.col("n_self") > 0) | F.col("has_parent"),
        "lookup": (F.col("n_columns") <= 5) & (F.col("n_in") > 0) & (F.col("n_out") <= 1) & F.col("has_lookup_name"),
        "orphan": (F.col("n_in") == 0) & (F.col("n_out") == 0),
    }
    return f.select("table_name", F.explode(F.array_compact(F.array(*[F.when(t, n) for n, t in found.items()]))).alias("pattern"))


def table_types(columns: DataFrame, rels: DataFrame) -> DataFrame:
    """(table_name, table_type): junction, lookup, reference or entity, by structure."""
    f = table_features(columns, rels)
    kind = F.when((F.col("n_fk") >= 2) & (F.col("n_non_key") <= 2), "junction").when((F.col("n_columns") <= 4) & F.col("has_unique"), "lookup").when((F.col("n_columns") <= 5) & (F.col("n_fk") == 0), "reference").otherwise("entity")
    return f.select("table_name", kind.alias("table_type"))


def node_type(hub_threshold: int = 5) -> Column:
    """Of a node with its degrees: junction (out >= 2, in <= 1), reference (by name), hub, entity."""
    n = F.col("node").cast("string")
    return (
        F.when((F.col("out_degree") >= 2) & (F.col("in_degree") <= 1), "junction")
        .when(has(n, "type", "status", "category", "lookup") | F.lower(n).endswith("_ref"), "reference")
        .when(F.col("degree") >= hub_threshold, "hub").otherwise("entity")
    )


def node_types(degrees: DataFrame, hub_threshold: int = 5) -> DataFrame:
    """(node, node_type) of graph nodes."""
    return degrees.select("node", node_type(hub_threshold).alias("node_type"))


def class_features(columns: DataFrame, rels: DataFrame) -> DataFrame:
    """(node, n_columns, n_fk, time_share, numeric_share, degree_share) of a catalog's tables; degrees are shares of the greatest."""
    d = rels.select(F.explode(F.array("source_table", "target_table")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    kind = lambda *k: F.avg(F.col("type_class").isin(*k).cast("double"))
    c = columns.groupBy(F.col("table_name").alias("node")).agg(F.count("*").alias("n_columns"), F.count_if("is_fk").alias("n_fk"), kind("datetime").alias("time_share"), kind("integer", "numeric").alias("numeric_share"))
    most = d.agg(F.coalesce(F.max("degree"), F.lit(1)).alias("most"))  # one row
    return c.join(d, "node", "left").crossJoin(F.broadcast(most)).select("node", "n_columns", "n_fk", "time_share", "numeric_share", (F.coalesce("degree", F.lit(0)) / F.col("most")).alias("degree_share"))


def structural_class(features: DataFrame) -> DataFrame:
    """(node, class) from (node, n_columns, n_fk, time_share, numeric_share, degree_share): JUNCTION, HUB, TEMPORAL, REFERENCE, METRICS, ISOLATED, ENTITY."""
    f = F.col
    kind = (
        F.when((f("n_fk") >= 2) & (f("n_fk") / f("n_columns") >= 0.4), "JUNCTION").when(f("degree_share") >= 0.7, "HUB").when(f("time_share") >= 0.4, "TEMPORAL")
        .when((f("n_columns") <= 5) & (f("n_fk") == 0) & (f("degree_share") > 0), "REFERENCE").when(f("numeric_share") >= 0.6, "METRICS").when(f("degree_share") == 0, "ISOLATED").otherwise("ENTITY")
    )
    return features.select("node", kind.alias("class"))


def complexity(columns: DataFrame, rels: DataFrame) -> DataFrame:
    """One row: 2 a table, 3 a relationship, 5 a pattern, 10 a junction, 2 times the mean columns; below 50 simple, below 150 moderate."""
    p = schema_patterns(columns, rels).agg(F.count_if(F.col("pattern") != "orphan").alias("patterns"), F.count_if(F.col("pattern") == "junction").alias("junctions"), F.count_if(F.col("pattern") == "orphan").alias("orphans"))
    t = columns.agg(F.count_distinct("table_name").alias("tables"), F.count("*").alias("columns"))
    r = rels.agg(F.count("*").alias("relationships"))
    score = 2 * F.col("tables") + 3 * F.col("relationships") + 5 * F.col("patterns") + 10 * F.col("junctions") + F.when(F.col("tables") > 0, 2 * F.col("columns") / F.col("tables")).otherwise(0.0)
    one = t.crossJoin(r).crossJoin(p).withColumn("score", score)  # one row each
    return one.withColumn("class", F.when(F.col("score") < 50, "simple").when(F.col("score") < 150, "moderate").otherwise("complex")).withColumn("max_depth", F.least(F.floor(F.sqrt("tables")), F.lit(10)).cast("int"))


def type_distribution(columns: DataFrame) -> DataFrame:
    """(table_name, shares): map from type class to its share of the table's columns."""
    n = columns.groupBy("table_name", "type_class").agg(F.count("*").alias("n"))
    total = columns.groupBy("table_name").agg(F.count("*").alias("total"))
    return n.join(total, "table_name").groupBy("table_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type_class", (F.col("n") / F.col("total")).alias("share"))))).alias("shares"))


def cardinality(symbol: Column) -> Column:
    """Of a diagram's relationship symbol: many-to-many, one-to-many, many-to-one or one-to-one."""
    left, right = F.substring(symbol, 1, 2).rlike("[{}]"), F.substring(symbol, -2, 2).rlike("[{}]")
    return F.when(left & right, "many-to-many").when(right, "one-to-many").when(left, "many-to-one").otherwise("one-to-one")
