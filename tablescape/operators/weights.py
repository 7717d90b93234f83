"""Edge weighting of relationships from structure, topology, constraints, similarity and meaning.

``rels``: (source_table, source_column, target_table, target_column,
nullable); ``columns`` as in ``patterns`` with ``is_nullable``; both are
catalog metadata, joined by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescape.functions.vectors import distribution_cosine, jaccard
from tablescape.operators.patterns import has
from tablescape.session import stage_buckets

STRUCTURAL, TOPOLOGICAL, CONSTRAINT, SIMILARITY = 0.4, 0.3, 0.2, 0.1


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def name_factor(source: Column, target: Column, source_column: Column, target_column: Column) -> Column:
    """Product of the factors that names earn, held to 0.5 to 2."""
    when = lambda t, f: F.when(t, f).otherwise(1.0)
    any_ = lambda *w: has(source, *w) | has(target, *w)
    out = (
        when(any_("user", "auth") | has(source_column, "user") | has(target_column, "user"), 1.4) * when(any_("status", "type"), 1.3) * when(any_("log", "audit"), 0.8)
        * when(any_("payment", "transaction", "donation"), 1.5) * when(any_("config", "setting"), 0.9) * when(any_("_", "mapping"), 1.1)
    )
    return clamp(out, 0.5, 2.0)


def semantic_weight(similarity: Column, threshold: float = 0.3) -> Column:
    """0.5 without a similarity, 0.1 below the threshold, else rescaled to 0.1 to 1."""
    return F.when(similarity.isNull(), 0.5).when(similarity < threshold, 0.1).otherwise(clamp((similarity - threshold) / (1 - threshold), 0.1, 1.0))


def final_weight(method: str = "additive", threshold: float = 0.3, conservative: bool = True, structural: float = 0.7, semantic: float = 0.3) -> Column:
    """Of the columns w_structural, w_topological, w_constraint, w_similarity and w_semantic."""
    s, t, c, m, x = (F.col(f"w_{n}") for n in ("structural", "topological", "constraint", "similarity", "semantic"))
    whole = 0.5 * s + 0.25 * t + 0.15 * c + 0.1 * m
    product = clamp(whole * x * (structural + semantic) + whole * (1 - structural - semantic), 0.1, 1.0)
    if conservative:
        product = F.when((whole < 0.4) | (x < threshold), F.least(whole, x) * 0.5).otherwise(product)
    if method == "multiplicative":
        return product
    if method == "hybrid":
        return F.when((whole >= 0.6) & (x >= 0.6), product).otherwise((whole * structural + x * semantic) * 0.8)
    return STRUCTURAL * s + TOPOLOGICAL * t + CONSTRAINT * c + SIMILARITY * m


def weighted(rels: DataFrame, columns: DataFrame, similarities: DataFrame | None = None, method: str = "additive", threshold: float = 0.3, conservative: bool = True) -> DataFrame:
    """``rels`` with the five weights, ``name_factor`` and ``w_final`` (held to 0.1 to 1). ``similarities``: (source_table, target_table, similarity)."""
    # a row a table holds all that a relationship asks of it, so each end is one join; what the source's columns say is read before the row goes on to the target
    deg = rels.select(F.explode(F.array("source_table", "target_table")).alias("t")).groupBy("t").agg(F.count("*").alias("d"))
    most = deg.agg(F.max("d").alias("most"))
    flags = ["column_type", "is_pk", "is_fk", "is_unique", "is_nullable"]
    per = columns.groupBy("table_name").agg(
        F.count("*").alias("n"), F.collect_list(F.struct("column_name", "type_class", *flags)).alias("cols"),
        F.map_from_arrays(F.array(*map(F.lit, ["pk", "fk", "unique", "nullable"])), F.array(*[F.avg(F.col(c).cast("double")) for c in ("is_pk", "is_fk", "is_unique", "is_nullable")])).alias("constraints"),
    ).join(deg.withColumnRenamed("t", "table_name"), "table_name")
    kinds = F.transform("cols", lambda c: c["type_class"])
    shares = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)) / F.col("n"))))
    per = per.withColumns({"names": F.array_distinct(F.transform("cols", lambda c: F.lower(c["column_name"]))), "shares": shares})
    # in as many buckets as a shuffle has partitions, so a task writes one and both joins shuffle relationships only
    per = stage_buckets(per, "weights-tables", "table_name", int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def placed(r: DataFrame, end: str, p: str) -> DataFrame:
        t = per.select(F.col("table_name").alias(f"{end}_table"), *[F.col(c).alias(f"{p}t_{c}") for c in ("n", "names", "constraints", "shares")], F.col("d").alias(f"{p}d"), "cols")
        j = r.join(t, f"{end}_table")
        found = F.explode_outer(F.filter("cols", lambda c: c["column_name"] == F.col(f"{end}_column"))).alias("c")
        return j.select(*[c for c in j.columns if c != "cols"], found).select("*", *[F.col(f"c.{c}").alias(f"{p}c_{c}") for c in flags]).drop("c")

    r = placed(placed(rels, "source", "s"), "target", "t").crossJoin(F.broadcast(most))  # one row
    if similarities is not None:
        r = r.join(similarities.select("source_table", "target_table", "similarity"), ["source_table", "target_table"], "left")
    else:
        r = r.withColumn("similarity", F.lit(None).cast("double"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    when = lambda t, w: F.when(t, w).otherwise(0.0)
    ratio = F.least("st_n", "tt_n") / F.greatest("st_n", "tt_n")
    single = F.when(flag("sc_is_unique") & flag("tc_is_pk"), 0.2).when(flag("tc_is_pk"), 0.15).when(~flag("sc_is_unique"), 0.1).otherwise(0.0)
    structural = F.lit(0.2) + F.when(F.col("nullable") == F.lit(False), 0.6).otherwise(0.1) + when(flag("tc_is_pk"), 0.3) + when(flag("sc_is_pk"), 0.2) + F.when(ratio < 0.5, 0.2).when(ratio < 0.8, 0.1).otherwise(0.0) + when(flag("sc_is_unique") | flag("tc_is_unique"), 0.15) + single
    # the ends of a relationship are adjacent, so their path is always short
    topological = 0.6 * F.greatest(F.lit(0.1), 1 - (F.col("sd") + F.col("td")) / 2 / F.col("most")) + 0.4
    constraint = F.lit(0.5) + when(F.col("sc_is_nullable") == F.lit(False), 0.25) + when(flag("tc_is_pk"), 0.15) + when(F.col("sc_column_type") == F.col("tc_column_type"), 0.1) + when(flag("sc_is_fk") | flag("sc_is_unique") | flag("sc_is_pk"), 0.1)
    alike = 0.3 * ratio + 0.3 * distribution_cosine(F.col("st_shares"), F.col("tt_shares")) + 0.2 * distribution_cosine(F.col("st_constraints"), F.col("tt_constraints")) + 0.2 * jaccard(F.col("st_names"), F.col("tt_names"))
    r = r.withColumns({"w_structural": clamp(structural, 0.0, 1.0), "w_topological": topological, "w_constraint": clamp(constraint, 0.0, 1.0), "w_similarity": alike, "w_semantic": semantic_weight(F.col("similarity"), threshold)})
    factor = name_factor(F.col("source_table"), F.col("target_table"), F.col("source_column"), F.col("target_column"))
    r = r.withColumn("name_factor", factor).withColumn("w_final", clamp(final_weight(method, threshold, conservative) * F.col("name_factor"), 0.1, 1.0))
    return r.select(*rels.columns, "w_structural", "w_topological", "w_constraint", "w_similarity", "w_semantic", "name_factor", "w_final")


def dependency_weight(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) with ``dependency``: 2 for an edge, 1.5 for one back, 1.2 for two hops over any node, else 1."""
    e = edges.select("src", "dst").distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    p = pairs.select("src", "dst").distinct()
    # two hops only from the pairs' own sources
    two = p.join(both.select("src", F.col("dst").alias("mid")), "src").join(both.select(F.col("src").alias("mid"), F.col("dst").alias("end")), "mid").where("end = dst").select("src", "dst").distinct().withColumn("two", F.lit(True))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back"))
    j = pairs.join(e.withColumn("direct", F.lit(True)), ["src", "dst"], "left").join(back, ["src", "dst"], "left").join(two, ["src", "dst"], "left")
    return j.withColumn("dependency", F.when(F.col("direct"), 2.0).when(F.col("back"), 1.5).when(F.col("two"), 1.2).otherwise(1.0)).drop("direct", "back", "two")
