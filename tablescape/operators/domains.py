"""Domains: choice of the algorithm, names, dominant hubs, scorecards, catalog statistics and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescape.functions.text import BUSINESS_TERMS, business_name
from tablescape.operators.clustering import best
from tablescape.operators.patterns import has


def path_for(n_tables: int) -> str:
    """simple below 20 tables, medium up to 50, else full."""
    return "simple" if n_tables < 20 else "medium" if n_tables <= 50 else "full"


def live_algorithm(n_tables: int, hub_share: float) -> str:
    return "dependency" if hub_share > 0.15 and n_tables >= 100 else "hub_seeded"


def algorithm_for(n_tables: int, density: float, hub_share: float) -> str:
    if density > 0.1 and hub_share < 0.1:
        return "spectral"
    if density < 0.05 and hub_share > 0.15:
        return "dbscan"
    return "hybrid" if n_tables > 100 else "spectral"


def fallback_for(components: int, largest_share: float, density: float, mean_degree: float, weight_variance: float, mega: bool = False) -> str:
    """The first fallback that the graph's shape calls for."""
    if mega:
        return "split"
    if components > 1 and largest_share < 0.8:
        return "components"
    if density < 0.001:
        return "components_with_singletons"
    if mean_degree < 1.5:
        return "constraints"
    return "bottom_up" if weight_variance > 0.5 else "features"


def foreign_key_buckets(columns: DataFrame) -> DataFrame:
    """(node, cluster): tables by the share of foreign keys: over half links, over a fifth mixed, else entities."""
    s = F.avg(F.col("is_fk").cast("double"))
    return columns.groupBy(F.col("table_name").alias("node")).agg(F.when(s > 0.5, "links").when(s > 0.2, "mixed").otherwise("entities").alias("cluster"))


def dominant_term(members: DataFrame) -> DataFrame:
    """(cluster, term): the business name that most of a cluster's (cluster, node) tables carry, two at least; ties in the order of the terms."""
    low = F.lower("node")
    found = F.array_compact(F.array(*[F.when(low.contains(t), F.struct(F.lit(i).alias("order"), F.lit(n).alias("term"))) for i, (t, n) in enumerate(BUSINESS_TERMS)]))
    c = members.select("cluster", F.explode(found).alias("f")).groupBy("cluster", "f.term").agg(F.count("*").alias("k"), F.min("f.order").alias("order")).where("k >= 2")
    return best(c.withColumn("k", F.col("k").cast("double")), ["cluster"], "k", "order").select("cluster", "term")


def domain_names(domains: DataFrame, terms: DataFrame) -> DataFrame:
    """(cluster, name) of (cluster, n, hubs): isolated, by the first hub, by the dominant term, by size."""
    d = domains.join(terms, "cluster", "left")
    c, hub = F.col("cluster").cast("string"), business_name(F.element_at("hubs", 1))
    name = (
        F.when(c.startswith("isolated_"), F.concat(F.lit("Isolated_Domain_"), F.element_at(F.split(c, "_"), 2)))
        .when(F.size("hubs") == 1, F.concat(hub, F.lit(" Domain"))).when(F.size("hubs") > 1, F.concat(hub, F.lit(" & Related Domains")))
        .when(F.col("term").isNotNull(), F.concat("term", F.lit(" Domain")))
        .when(F.col("n") >= 20, F.concat(F.lit("Large Domain "), c)).when(F.col("n") <= 5, F.concat(F.lit("Small Domain "), c)).otherwise(F.concat(F.lit("Mixed Domain "), c))
    )
    return d.select("cluster", name.alias("name"))


def dominant_hub(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """(cluster, hub): the hub that most tables' names contain, a half more if it is a member, one more if it has that name itself; ties by name."""
    m = members.select("cluster", F.lower("node").alias("node"))
    j = m.crossJoin(hubs.select(F.col("node").alias("hub")))  # tables by hubs, of which there are few
    s = F.when(F.col("node").contains(F.lower("hub")), 1.0).otherwise(0.0) + F.when(F.col("node") == F.lower("hub"), 1.5).otherwise(0.0)
    return best(j.groupBy("cluster", "hub").agg(F.sum(s).alias("s")).where("s > 0"), ["cluster"], "s", "hub").select("cluster", "hub")


def business_coherence(members: DataFrame) -> DataFrame:
    """(cluster, coherence): the share of a cluster's tables that carry its dominant business name, 0 without one."""
    t = dominant_term(members)
    pick = None
    for term, name in BUSINESS_TERMS:
        pick = F.when(F.lower("node").contains(term), name) if pick is None else pick.when(F.lower("node").contains(term), name)
    j = members.withColumn("own", pick).join(t, "cluster", "left")
    return j.groupBy("cluster").agg(F.avg(F.coalesce((F.col("own") == F.col("term")).cast("double"), F.lit(0.0))).alias("coherence"))


def cluster_scores(report: DataFrame, coherence: DataFrame) -> DataFrame:
    """(cluster, connectivity, separation, business, size_fit, score): .3/.2/.25/.25; size fits from 3 to 15."""
    n = F.col("n_nodes")
    c = report.join(coherence, "cluster", "left")
    fit = F.when((n >= 3) & (n <= 15), 1.0).when(n < 3, n / 3).otherwise(F.greatest(F.lit(0.2), 15 / n))
    x = c.select("cluster", F.when(n <= 1, 1.0).otherwise(F.least(F.lit(1.0), "density")).alias("connectivity"), (1 - F.col("conductance")).alias("separation"), F.coalesce("coherence", F.lit(0.0)).alias("business"), fit.alias("size_fit"))
    return x.withColumn("score", 0.3 * F.col("connectivity") + 0.2 * F.col("separation") + 0.25 * F.col("business") + 0.25 * F.col("size_fit"))


def overall_quality(silhouette: Column, davies_bouldin: Column, calinski: Column, dunn: Column, coherence: Column, balance: Column) -> Column:
    """.25/.2/.15/.1/.2/.1 of the indices, each brought to 0 to 1."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return 0.25 * unit((silhouette + 1) / 2) + 0.2 * unit(1 / (1 + davies_bouldin)) + 0.15 * unit(calinski / (calinski + 100)) + 0.1 * unit(dunn) + 0.2 * unit(coherence) + 0.1 * unit(balance)


def semantic_validity(edges: DataFrame, membership: DataFrame, columns: DataFrame) -> DataFrame:
    """One row: references kept, edges kept inside, fan-in spread and homogeneity of types, .4/.3/.2/.1."""
    from tablescape.operators.patterns import type_distribution
    from tablescape.operators.validation import placed

    p = placed(edges, membership)
    all_ = edges.agg(F.count("*").alias("all"))
    kept = p.agg(F.count("*").alias("kept"), F.count_if(F.col("cs") == F.col("cd")).alias("inside"))
    fan = p.groupBy("dst").agg(F.count("*").alias("k")).agg(F.avg(1 / F.col("k")).alias("fan"))
    t = type_distribution(columns).select(F.col("table_name").alias("node"), F.explode("shares").alias("kind", "share")).join(membership, "node").groupBy("cluster", "kind").agg(F.avg("share").alias("s"))
    same = t.groupBy("cluster").agg(F.max("s").alias("top")).agg(F.avg("top").alias("same"))
    x = all_.crossJoin(kept).crossJoin(fan).crossJoin(same)  # one row each
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(1.0))
    return x.select(share("kept", "all").alias("integrity"), share("inside", "kept").alias("preservation"), F.coalesce("fan", F.lit(1.0)).alias("cardinality"), F.coalesce("same", F.lit(0.0)).alias("homogeneity")).withColumn(
        "score", 0.4 * F.col("integrity") + 0.3 * F.col("preservation") + 0.2 * F.col("cardinality") + 0.1 * F.col("homogeneity")
    )


def verdict(structural: Column, semantic: Column, graph: Column, business: Column, critical: Column) -> Column:
    """(score, valid): .25/.35/.25/.15; valid from .6 on without a critical issue."""
    s = 0.25 * structural + 0.35 * semantic + 0.25 * graph + 0.15 * business
    return F.struct(s.alias("score"), ((s >= 0.6) & ~critical).alias("valid"))


def business_constraints(edges: DataFrame, membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: shares of edges across clusters, of orphans and of nodes on cycles inside clusters, and 1 less .3/.3/.2 of them."""
    from tablescape.operators.graph import cycles
    from tablescape.operators.validation import placed

    p = placed(edges, membership)
    cross = p.agg(F.coalesce(F.avg((F.col("cs") != F.col("cd")).cast("double")), F.lit(0.0)).alias("cross"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    lone = nodes.join(ends.withColumn("linked", F.lit(1)), "node", "left").agg(F.avg(F.col("linked").isNull().cast("double")).alias("orphans"), F.count("*").alias("n"))
    on = cycles(p.where("cs = cd").select("src", "dst")).agg(F.count("*").alias("c"))
    x = cross.crossJoin(lone).crossJoin(on)  # one row each
    return x.select("cross", "orphans", (F.col("c") / F.col("n")).alias("cyclic")).withColumn("score", 1 - 0.3 * F.col("cross") - 0.3 * F.col("orphans") - 0.2 * F.col("cyclic"))


def table_statistics(columns: DataFrame, rels: DataFrame) -> DataFrame:
    """(table_name, n_columns, n_rels, has_audit, size): large above 15 columns, medium above 7."""
    r = rels.select(F.explode(F.array_distinct(F.array("source_table", "target_table"))).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n_rels"))
    c = columns.groupBy("table_name").agg(F.count("*").alias("n_columns"), F.bool_or(has(F.col("column_name"), "createdat", "updatedat", "createdby", "modifiedby")).alias("has_audit"))
    return c.join(r, "table_name", "left").na.fill(0, ["n_rels"]).withColumn("size", F.when(F.col("n_columns") > 15, "large").when(F.col("n_columns") > 7, "medium").otherwise("small"))


def table_text(columns: DataFrame, rels: DataFrame, most: int = 8000) -> DataFrame:
    """(table_name, text): name, columns with types, keys and references in words, cut to ``most`` characters and ``...``."""
    r = rels.groupBy(F.col("source_table").alias("table_name")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("source_column", F.lit(" references "), "target_table"))), ", ").alias("refs"))
    c = columns.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws(" ", "column_name", "column_type").alias("c")))), lambda x: x["c"]), ", ").alias("cols"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_pk"), F.col("column_name")))), ", ").alias("keys"))
    t = F.concat(F.lit("Table "), "table_name", F.lit(". Columns: "), "cols", F.lit(". Primary keys: "), "keys", F.lit(". Foreign keys: "), F.coalesce("refs", F.lit("")), F.lit("."))
    return c.join(r, "table_name", "left").select("table_name", F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t).alias("text"))


def infer_keys(columns: DataFrame) -> DataFrame:
    """(source_table, source_column, target_table): columns named ``<table>Id``, ``<table>_id`` or ``<table>`` + ``fk``, of another table; the longest table name wins, ties by name."""
    t = columns.select(F.col("table_name").alias("target_table")).distinct()
    stem = F.regexp_replace(F.lower("column_name"), r"(_?id|_?fk)$", "")
    c = columns.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), stem.alias("stem")).where(F.lower("source_column") != F.col("stem")).where("stem <> ''")
    names = t.select("target_table", F.explode(F.array_distinct(F.array(F.lower("target_table"), F.regexp_replace(F.lower("target_table"), "s$", "")))).alias("stem"))
    j = c.join(names, "stem").where("source_table <> target_table")
    return j.groupBy("source_table", "source_column").agg(F.min(F.struct((-F.length("target_table")).alias("l"), "target_table")).alias("t")).select("source_table", "source_column", "t.target_table")


def key_columns(links: DataFrame, columns: DataFrame) -> DataFrame:
    """(source_table, target_table, source_column): the column of the source that is named ``<target>Id``, else its first foreign key whose name contains the target's, else an empty string.

    Names are compared in any case, the first column by ordinal wins; repeated
    links are one; links with a null end have an empty column; a source without
    columns too. An empty table gives an empty result.
    """
    pairs = links.select("source_table", "target_table").distinct()
    low, to = F.lower("column_name"), F.lower("target_table")
    rank = F.when(low == F.concat(to, F.lit("id")), 0).when(F.col("is_fk") & F.contains(low, to), 1)
    c = columns.select(F.col("table_name").alias("source_table"), "column_name", "ordinal", "is_fk")
    found = pairs.join(c, "source_table").withColumn("rank", rank).where("rank IS NOT NULL")
    best = found.groupBy("source_table", "target_table").agg(F.min(F.struct("rank", "ordinal", "column_name")).alias("b"))
    return pairs.join(best, ["source_table", "target_table"], "left").select("source_table", "target_table", F.coalesce("b.column_name", F.lit("")).alias("source_column"))


def junction_flag(columns: DataFrame) -> DataFrame:
    """(table_name, is_junction): two foreign keys at least, and five columns at most or a name that joins two words."""
    g = columns.groupBy("table_name").agg(F.count_if("is_fk").alias("fk"), F.count("*").alias("n"))
    name = F.col("table_name").rlike("_") | has(F.col("table_name"), "mapping", "junction", "link")
    return g.select("table_name", ((F.col("fk") >= 2) & ((F.col("n") <= 5) | name)).alias("is_junction"))


def domains_of(membership: DataFrame) -> DataFrame:
    """(table_name, primary, domains): of (table_name, domain[, confidence]) all domains and the most confident; ``overview`` for a null one."""
    conf = F.col("confidence") if "confidence" in membership.columns else F.lit(1.0)
    d = membership.select("table_name", F.coalesce("domain", F.lit("overview")).alias("domain"), conf.alias("c"))
    return d.groupBy("table_name").agg(F.min(F.struct((-F.col("c")).alias("c"), "domain")).alias("p"), F.array_sort(F.collect_set("domain")).alias("domains")).select("table_name", F.col("p.domain").alias("primary"), "domains")


def codes_for(mappings: DataFrame, table: str | None = None, column: str | None = None, words: str | None = None) -> DataFrame:
    """Code mappings of a table and field, else of a table, else with the words in any of five texts; (table_name, field_name, sheet_name, code_values array of (code, description))."""
    if table and column:
        return mappings.where((F.lower("table_name") == table.lower()) & (F.lower("field_name") == column.lower()))
    if table:
        return mappings.where(F.lower("table_name") == table.lower())
    if not words:
        return mappings
    q = words.lower()
    return mappings.where(F.lower(F.concat_ws(" ", "table_name", "field_name", "sheet_name")).contains(q) | F.exists("code_values", lambda v: F.lower(v["code"]).contains(q) | F.lower(v["description"]).contains(q)))


def project_sizes(files: DataFrame) -> DataFrame:
    """(project_id, n_tables, n_relationships) of the newest file of each project: (project_id, updated_at, data JSON with tables and relationships)."""
    shape = "tables array<struct<name: string>>, relationships array<struct<sourceTable: string>>"
    top = files.groupBy("project_id").agg(F.max(F.struct("updated_at", "data")).alias("f"))
    return top.select("project_id", F.from_json("f.data", shape).alias("d")).select("project_id", F.coalesce(F.size("d.tables"), F.lit(0)).alias("n_tables"), F.coalesce(F.size("d.relationships"), F.lit(0)).alias("n_relationships"))
