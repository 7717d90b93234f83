"""Registered queries over a wide catalog that Spark derives from orders and their lines: a table an order, a column a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescape.functions import text
from tablescape.operators import clustering, domains, hubs, patterns, weights
from tablescape.queries import _rounds_sql, query
from tablescape.session import stage
from tablescape.sources import mermaid
from tablescape.sources.catalog import CLASSES, COLUMN_WORDS, TABLE_WORDS, TYPES, order_catalog, order_links, part_sequence, read


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


CATALOG = f"""
    lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal FROM lineitem),
    cols AS (SELECT l_orderkey AS k, replace({_list(TABLE_WORDS)}[l_orderkey % {len(TABLE_WORDS)} + 1], '#', CAST(l_orderkey AS VARCHAR)) AS table_name, ordinal, {_list(COLUMN_WORDS)}[(l_partkey + ordinal) % {len(COLUMN_WORDS)} + 1] || '_' || ordinal AS column_name,
        {_list(TYPES)}[l_suppkey % {len(TYPES)} + 1] AS column_type, {_list(CLASSES)}[l_suppkey % {len(CLASSES)} + 1] AS type_class, ordinal = 1 AS is_pk, ordinal > 1 AND l_partkey % 3 = 0 AS is_fk, l_suppkey % 7 = 0 AS is_unique, l_quantity > 25 AS is_nullable, l_suppkey % 11 = 0 AS own FROM lines),
    before AS (SELECT o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
    rels AS (SELECT c.table_name AS source_table, c.column_name AS source_column, t.table_name AS target_table, t.column_name AS target_column, c.is_nullable AS nullable
        FROM cols c JOIN before b ON c.k = b.k JOIN cols t ON t.ordinal = 1 AND t.k = CASE WHEN c.own THEN c.k ELSE b.p END WHERE c.is_fk)"""
HAS = lambda c, *words: f"regexp_matches(lower({c}), '{'|'.join(words)}')"
FEATURES = f"""
    f0 AS (SELECT table_name, count(*) AS n_columns, count(*) FILTER (is_fk) AS n_fk, count(*) FILTER (NOT is_fk AND NOT is_pk) AS n_non_key, bool_or(is_unique) AS has_unique, count(*) FILTER ({HAS('column_name', 'createdat', 'updatedat', 'createdby', 'modifiedby', 'lastmodifiedby', 'lastmodifiedon')}) AS n_audit,
        bool_or(contains(lower(column_name), 'parent')) AS has_parent, bool_or({HAS('column_name', 'name', 'label', 'code', 'value', 'description', 'type')}) AS has_lookup FROM cols GROUP BY 1),
    fo AS (SELECT source_table AS t, count(*) AS n_out, count(*) FILTER (source_table = target_table) AS n_self FROM rels GROUP BY 1), fi AS (SELECT target_table AS t, count(*) AS n_in FROM rels GROUP BY 1),
    f AS (SELECT f0.*, coalesce(n_out, 0) AS n_out, coalesce(n_self, 0) AS n_self, coalesce(n_in, 0) AS n_in FROM f0 LEFT JOIN fo ON fo.t = table_name LEFT JOIN fi ON fi.t = table_name),
    pat AS (SELECT table_name, 'junction' AS pattern FROM f WHERE n_fk >= 2 AND n_columns <= 6 AND n_out >= 2 UNION ALL SELECT table_name, 'audit_trail' FROM f WHERE n_audit >= 2 UNION ALL SELECT table_name, 'hierarchy' FROM f WHERE n_self > 0 OR has_parent
        UNION ALL SELECT table_name, 'lookup' FROM f WHERE n_columns <= 5 AND n_in > 0 AND n_out <= 1 AND has_lookup UNION ALL SELECT table_name, 'orphan' FROM f WHERE n_in = 0 AND n_out = 0)"""


def _importance(c: str) -> str:
    best = ", ".join(f"CASE WHEN contains(lower({c}), '{k}') THEN {w} ELSE 0 END" for k, w in patterns.IMPORTANCE.items())
    return f"greatest(0.1, least(1.0, greatest(0.5, {best}) * CASE WHEN {HAS(c, 'temp', 'cache', 'queue')} OR starts_with(lower({c}), 'sys_') OR starts_with(lower({c}), 'tmp_') THEN 0.3 ELSE 1 END))"


def _kinds(s: str, t: str) -> dict[str, str]:
    """Kind, strength and nature of a relationship between columns ``s`` and ``t``."""
    stem = lambda c: f"regexp_replace(lower({c}), 's$', '')"
    composed = f"(contains(lower({s}), {stem(t)}) OR contains(lower({t}), {stem(s)}))"
    return {
        "kind": f"CASE WHEN {HAS(s, 'base', 'parent')} OR {HAS(t, 'base', 'parent')} THEN 'inheritance' WHEN {composed} THEN 'composition' WHEN {HAS(s, 'user', 'customer')} OR {HAS(t, 'profile', 'settings')} THEN 'aggregation' ELSE 'association' END",
        "strength": f"round(greatest(0.1, least(1.0, 0.5 + CASE WHEN {composed} THEN 0.3 ELSE 0 END + ({_importance(s)} + {_importance(t)}) * 0.1 - CASE WHEN {HAS(t, 'type', 'status', 'category')} THEN 0.2 ELSE 0 END)), 6)",
        "nature": f"CASE WHEN {_importance(s)} >= 0.7 AND {_importance(t)} >= 0.7 THEN 'core' WHEN {HAS(t, 'type', 'status', 'category', 'lookup')} OR ends_with(lower({t}), '_ref') THEN 'lookup' WHEN {HAS(t, 'log', 'audit', 'history')} OR {HAS(s, 'log', 'audit')} THEN 'audit' WHEN {HAS(t, 'config', 'setting', 'metadata', 'template')} THEN 'metadata' ELSE 'supporting' END",
    }


@query("schema_patterns", f"WITH {CATALOG}, {FEATURES} SELECT * FROM pat")
def schema_patterns(spark, sf_dir):
    return patterns.schema_patterns(*order_catalog(spark, sf_dir))


@query("key_columns", f"""WITH {CATALOG}, links AS (SELECT DISTINCT table_name AS source_table, regexp_extract(column_name, '^[A-Za-z]+') AS target_table FROM cols),
    hits AS (SELECT source_table, target_table, column_name, row_number() OVER (PARTITION BY source_table, target_table ORDER BY CASE WHEN lower(column_name) = lower(target_table) || 'id' THEN 0 ELSE 1 END, ordinal) AS r
        FROM links JOIN cols ON source_table = table_name WHERE lower(column_name) = lower(target_table) || 'id' OR is_fk AND contains(lower(column_name), lower(target_table)))
    SELECT source_table, target_table, coalesce(column_name, '') AS source_column FROM links LEFT JOIN hits USING (source_table, target_table) WHERE r IS NULL OR r = 1""")
def key_columns(spark, sf_dir):
    columns = order_catalog(spark, sf_dir)[0]
    links = columns.select(F.col("table_name").alias("source_table"), F.regexp_extract("column_name", "^[A-Za-z]+", 0).alias("target_table"))
    return domains.key_columns(links, columns)


@query("table_types", f"WITH {CATALOG}, {FEATURES} SELECT table_name, CASE WHEN n_fk >= 2 AND n_non_key <= 2 THEN 'junction' WHEN n_columns <= 4 AND has_unique THEN 'lookup' WHEN n_columns <= 5 AND n_fk = 0 THEN 'reference' ELSE 'entity' END AS table_type FROM f")
def table_types(spark, sf_dir):
    return patterns.table_types(*order_catalog(spark, sf_dir))


@query("schema_complexity", f"""WITH {CATALOG}, {FEATURES}, p AS (SELECT count(*) FILTER (pattern <> 'orphan') AS patterns, count(*) FILTER (pattern = 'junction') AS junctions, count(*) FILTER (pattern = 'orphan') AS orphans FROM pat),
    t AS (SELECT count(DISTINCT table_name) AS tables, count(*) AS "columns" FROM cols), r AS (SELECT count(*) AS relationships FROM rels), s AS (SELECT *, 2 * tables + 3 * relationships + 5 * patterns + 10 * junctions + 2 * "columns" / tables AS score FROM t, r, p)
    SELECT tables, "columns", relationships, patterns, junctions, orphans, round(score, 6) AS score, CASE WHEN score < 50 THEN 'simple' WHEN score < 150 THEN 'moderate' ELSE 'complex' END AS class, CAST(least(floor(sqrt(tables)), 10) AS INTEGER) AS max_depth FROM s""")
def schema_complexity(spark, sf_dir):
    return patterns.complexity(*order_catalog(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("relationship_kinds", f"WITH {CATALOG} SELECT source_table, source_column, {', '.join(f'{e} AS {n}' for n, e in _kinds('source_table', 'target_table').items())}, {_importance('source_table')} AS importance FROM rels")
def relationship_kinds(spark, sf_dir):
    r = order_catalog(spark, sf_dir)[1]
    s, t = F.col("source_table"), F.col("target_table")
    return r.select(s, "source_column", patterns.relationship_kind(s, t).alias("kind"), F.round(patterns.relationship_strength(s, t), 6).alias("strength"), patterns.business_nature(s, t).alias("nature"), patterns.importance(s).alias("importance"))


@query("structural_classes", f"""WITH {CATALOG}, d AS (SELECT t, count(*) AS d FROM (SELECT source_table AS t FROM rels UNION ALL SELECT target_table FROM rels) GROUP BY 1), m AS (SELECT max(d) AS most FROM d),
    x AS (SELECT table_name AS node, count(*) AS n, count(*) FILTER (is_fk) AS fk, avg(CASE WHEN type_class = 'datetime' THEN 1.0 ELSE 0 END) AS ts, avg(CASE WHEN type_class IN ('integer', 'numeric') THEN 1.0 ELSE 0 END) AS ns FROM cols GROUP BY 1),
    y AS (SELECT x.*, coalesce(d, 0) / most AS ds FROM x LEFT JOIN d ON t = node, m)
    SELECT node, CASE WHEN fk >= 2 AND fk / n >= 0.4 THEN 'JUNCTION' WHEN ds >= 0.7 THEN 'HUB' WHEN ts >= 0.4 THEN 'TEMPORAL' WHEN n <= 5 AND fk = 0 AND ds > 0 THEN 'REFERENCE' WHEN ns >= 0.6 THEN 'METRICS' WHEN ds = 0 THEN 'ISOLATED' ELSE 'ENTITY' END AS class FROM y""")
def structural_classes(spark, sf_dir):
    return patterns.structural_class(patterns.class_features(*order_catalog(spark, sf_dir)))


@query("type_shares", f"WITH {CATALOG}, n AS (SELECT table_name, type_class, count(*) AS n FROM cols GROUP BY 1, 2) SELECT table_name, type_class, round(n / sum(n) OVER (PARTITION BY table_name), 6) AS share FROM n")
def type_shares(spark, sf_dir):
    d = patterns.type_distribution(order_catalog(spark, sf_dir)[0])
    return d.select("table_name", F.explode("shares").alias("type_class", "share")).withColumn("share", F.round("share", 6))


@query("hub_types", """
    WITH c AS (SELECT l_partkey AS node, count(*) AS d, count(*) FILTER (l_linenumber % 3 = 0) AS o2m, count(*) FILTER (l_linenumber % 3 = 2) AS m2m, count(*) FILTER (l_discount * 10 >= 0.5) AS strong FROM lineitem GROUP BY 1),
    x AS (SELECT p_partkey AS node, p_size AS cols, p_partkey % 4 AS fk, 1 + p_partkey % 2 AS pk, p_partkey % 5 = 0 AS has_time, coalesce(d, 0) AS d, coalesce(o2m, 0) AS o2m, coalesce(m2m, 0) AS m2m, coalesce(strong, 0) AS strong FROM part LEFT JOIN c ON node = p_partkey),
    s AS (SELECT node, CASE WHEN cols < 10 AND d > 10 THEN 4 ELSE 0 END + CASE WHEN o2m > d * 0.8 THEN 3 ELSE 0 END + CASE WHEN fk <= 1 THEN 3 ELSE 0 END AS l, CASE WHEN fk >= 2 AND fk / cols > 0.5 THEN 5 ELSE 0 END + CASE WHEN m2m > 0 THEN 3 ELSE 0 END + CASE WHEN cols <= 5 THEN 2 ELSE 0 END AS j,
        CASE WHEN cols > 20 AND d > 15 THEN 4 ELSE 0 END + CASE WHEN o2m > d * 0.6 THEN 3 ELSE 0 END + CASE WHEN pk = 1 AND fk <= 2 THEN 3 ELSE 0 END AS m, CASE WHEN has_time THEN 3 ELSE 0 END + CASE WHEN d > 20 AND cols < 15 THEN 4 ELSE 0 END + CASE WHEN strong = 0 THEN 3 ELSE 0 END AS a FROM x)
    SELECT node, CASE greatest(l, j, m, a) WHEN l THEN 'lookup' WHEN j THEN 'junction' WHEN m THEN 'master' ELSE 'audit' END AS hub_type, greatest(l, j, m, a) / 10 AS hub_score, greatest(l, j, m, a) > 5 AS is_hub FROM s""")
def hub_types(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("n_columns"), (F.col("p_partkey") % 4).alias("n_fk"), (1 + F.col("p_partkey") % 2).alias("n_pk"), (F.col("p_partkey") % 5 == 0).alias("has_time"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "one-to-many").when(F.col("l_linenumber") % 3 == 1, "many-to-one").otherwise("many-to-many")
    return hubs.hub_type(p, read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), (F.col("l_discount") * 10).alias("weight"), kind.alias("kind")))


@query("edge_weights", f"""WITH {CATALOG},
    tn AS (SELECT table_name AS t, count(*) AS n, list_distinct(list(lower(column_name))) AS names, avg(CAST(is_pk AS INT)) AS pk, avg(CAST(is_fk AS INT)) AS fk, avg(CAST(is_unique AS INT)) AS u, avg(CAST(is_nullable AS INT)) AS nl FROM cols GROUP BY 1),
    ty AS (SELECT table_name AS t, type_class AS k, count(*) AS c FROM cols GROUP BY 1, 2), nm AS (SELECT t, sqrt(sum(c * c)) AS nm FROM ty GROUP BY 1),
    d AS (SELECT t, count(*) AS d FROM (SELECT source_table AS t FROM rels UNION ALL SELECT target_table FROM rels) GROUP BY 1), m AS (SELECT max(d) AS most FROM d),
    dot AS (SELECT r.source_table, r.target_table, sum(a.c * b.c) AS dot FROM (SELECT DISTINCT source_table, target_table FROM rels) r JOIN ty a ON a.t = r.source_table JOIN ty b ON b.t = r.target_table AND a.k = b.k GROUP BY 1, 2),
    x AS (SELECT r.source_table, r.source_column, r.target_table, r.target_column, r.nullable, s.is_pk AS sp, s.is_fk AS sf, s.is_unique AS su, s.is_nullable AS sn, s.column_type AS st, t.is_pk AS tp, t.is_unique AS tu, t.column_type AS tt, least(a.n, b.n) / greatest(a.n, b.n) AS ratio, coalesce(dot, 0) / (na.nm * nb.nm) AS tc,
        (a.pk * b.pk + a.fk * b.fk + a.u * b.u + a.nl * b.nl) / (sqrt(a.pk * a.pk + a.fk * a.fk + a.u * a.u + a.nl * a.nl) * sqrt(b.pk * b.pk + b.fk * b.fk + b.u * b.u + b.nl * b.nl)) AS cc, len(list_intersect(a.names, b.names)) / len(list_distinct(list_concat(a.names, b.names))) AS jac, da.d AS sd, db.d AS td, most
        FROM rels r JOIN cols s ON s.table_name = source_table AND s.column_name = source_column JOIN cols t ON t.table_name = target_table AND t.column_name = target_column JOIN tn a ON a.t = source_table JOIN tn b ON b.t = target_table JOIN nm na ON na.t = source_table JOIN nm nb ON nb.t = target_table
        LEFT JOIN dot ON dot.source_table = r.source_table AND dot.target_table = r.target_table JOIN d da ON da.t = r.source_table JOIN d db ON db.t = r.target_table, m),
    w AS (SELECT *, least(1, 0.2 + CASE WHEN NOT nullable THEN 0.6 ELSE 0.1 END + CASE WHEN tp THEN 0.3 ELSE 0 END + CASE WHEN sp THEN 0.2 ELSE 0 END + CASE WHEN ratio < 0.5 THEN 0.2 WHEN ratio < 0.8 THEN 0.1 ELSE 0 END + CASE WHEN su OR tu THEN 0.15 ELSE 0 END + CASE WHEN su AND tp THEN 0.2 WHEN tp THEN 0.15 WHEN NOT su THEN 0.1 ELSE 0 END) AS ws,
        0.6 * greatest(0.1, 1 - (sd + td) / 2 / most) + 0.4 AS wt, least(1, 0.5 + CASE WHEN NOT sn THEN 0.25 ELSE 0 END + CASE WHEN tp THEN 0.15 ELSE 0 END + CASE WHEN st = tt THEN 0.1 ELSE 0 END + CASE WHEN sf OR su OR sp THEN 0.1 ELSE 0 END) AS wc, 0.3 * ratio + 0.3 * tc + 0.2 * cc + 0.2 * jac AS wm,
        greatest(0.5, least(2, CASE WHEN {HAS('source_table', 'user', 'auth')} OR {HAS('target_table', 'user', 'auth')} OR contains(lower(source_column), 'user') OR contains(lower(target_column), 'user') THEN 1.4 ELSE 1 END * CASE WHEN {HAS('source_table', 'status', 'type')} OR {HAS('target_table', 'status', 'type')} THEN 1.3 ELSE 1 END
            * CASE WHEN {HAS('source_table', 'log', 'audit')} OR {HAS('target_table', 'log', 'audit')} THEN 0.8 ELSE 1 END * CASE WHEN {HAS('source_table', 'payment', 'transaction', 'donation')} OR {HAS('target_table', 'payment', 'transaction', 'donation')} THEN 1.5 ELSE 1 END * CASE WHEN {HAS('source_table', 'config', 'setting')} OR {HAS('target_table', 'config', 'setting')} THEN 0.9 ELSE 1 END
            * CASE WHEN {HAS('source_table', '_', 'mapping')} OR {HAS('target_table', '_', 'mapping')} THEN 1.1 ELSE 1 END)) AS nf FROM x)
    SELECT source_table, source_column, round(ws, 5) AS w_structural, round(wt, 5) AS w_topological, round(wc, 5) AS w_constraint, round(wm, 5) AS w_similarity, round(nf, 5) AS name_factor, round(greatest(0.1, least(1, (0.4 * ws + 0.3 * wt + 0.2 * wc + 0.1 * wm) * nf)), 5) AS w_final FROM w""")
def edge_weights(spark, sf_dir):
    c, r = order_catalog(spark, sf_dir)
    w = weights.weighted(r, c)
    return w.select("source_table", "source_column", *[F.round(n, 5).alias(n) for n in ("w_structural", "w_topological", "w_constraint", "w_similarity", "name_factor", "w_final")])


@query("weight_methods", """
    WITH v AS (SELECT l_returnflag, l_linenumber, l_discount * 10 AS s, l_quantity / 50 AS t, (l_linenumber % 10) / 10 AS c, (l_partkey % 10) / 10 AS m, CASE WHEN l_suppkey % 4 <> 0 THEN (l_suppkey % 21) / 20 END AS sim FROM lineitem),
    x AS (SELECT *, CASE WHEN sim IS NULL THEN 0.5 WHEN sim < 0.3 THEN 0.1 ELSE greatest(0.1, least(1, (sim - 0.3) / 0.7)) END AS x, 0.5 * s + 0.25 * t + 0.15 * c + 0.1 * m AS w FROM v),
    p AS (SELECT *, CASE WHEN w < 0.4 OR x < 0.3 THEN least(w, x) * 0.5 ELSE greatest(0.1, least(1, w * x)) END AS p FROM x)
    SELECT l_returnflag, l_linenumber, round(avg(x), 6) AS semantic, round(avg(0.4 * s + 0.3 * t + 0.2 * c + 0.1 * m), 6) AS additive, round(avg(p), 6) AS multiplicative, round(avg(CASE WHEN w >= 0.6 AND x >= 0.6 THEN p ELSE (w * 0.7 + x * 0.3) * 0.8 END), 6) AS hybrid FROM p GROUP BY 1, 2""")
def weight_methods(spark, sf_dir):
    c = F.col
    v = read(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linenumber", (c("l_discount") * 10).alias("w_structural"), (c("l_quantity") / 50).alias("w_topological"), (c("l_linenumber") % 10 / 10).alias("w_constraint"), (c("l_partkey") % 10 / 10).alias("w_similarity"),
        weights.semantic_weight(F.when(c("l_suppkey") % 4 != 0, c("l_suppkey") % 21 / 20)).alias("w_semantic"),
    )
    return v.groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("w_semantic"), 6).alias("semantic"), *[F.round(F.avg(weights.final_weight(m)), 6).alias(m) for m in ("additive", "multiplicative", "hybrid")])


@query("table_statistics", f"""WITH {CATALOG}, r AS (SELECT t, count(*) AS n FROM (SELECT source_table AS t FROM rels UNION ALL SELECT target_table FROM rels WHERE source_table <> target_table) GROUP BY 1)
    SELECT table_name, count(*) AS n_columns, bool_or({HAS('column_name', 'createdat', 'updatedat', 'createdby', 'modifiedby')}) AS has_audit, coalesce(max(n), 0) AS n_rels, CASE WHEN count(*) > 15 THEN 'large' WHEN count(*) > 7 THEN 'medium' ELSE 'small' END AS size FROM cols LEFT JOIN r ON t = table_name GROUP BY 1""")
def table_statistics(spark, sf_dir):
    return domains.table_statistics(*order_catalog(spark, sf_dir))


@query("table_texts", f"""WITH {CATALOG}, r AS (SELECT source_table AS t, string_agg(source_column || ' references ' || target_table, ', ' ORDER BY source_column || ' references ' || target_table) AS refs FROM rels GROUP BY 1),
    c AS (SELECT table_name, string_agg(column_name || ' ' || column_type, ', ' ORDER BY ordinal) AS cols, coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (is_pk), '') AS keys FROM cols GROUP BY 1)
    SELECT table_name, 'Table ' || table_name || '. Columns: ' || cols || '. Primary keys: ' || keys || '. Foreign keys: ' || coalesce(refs, '') || '.' AS text FROM c LEFT JOIN r ON t = table_name""")
def table_texts(spark, sf_dir):
    return domains.table_text(*order_catalog(spark, sf_dir))


@query("table_contexts", f"""WITH {CATALOG} SELECT table_name, string_agg(column_name || ' ' || column_type || CASE WHEN is_pk THEN ' PK' WHEN is_fk THEN ' FK' ELSE '' END || coalesce(' -> ' || target_table || '.' || target_column, ''), ', ' ORDER BY ordinal) AS text
    FROM cols LEFT JOIN rels ON source_table = table_name AND source_column = column_name GROUP BY 1""")
def table_contexts(spark, sf_dir):
    return mermaid.context(*order_catalog(spark, sf_dir))


@query("junction_flags", f"WITH {CATALOG} SELECT table_name, count(*) FILTER (is_fk) >= 2 AND (count(*) <= 5 OR contains(table_name, '_') OR {HAS('table_name', 'mapping', 'junction', 'link')}) AS is_junction FROM cols GROUP BY 1")
def junction_flags(spark, sf_dir):
    return domains.junction_flag(order_catalog(spark, sf_dir)[0])


@query("key_buckets", f"WITH {CATALOG} SELECT table_name AS node, CASE WHEN avg(CAST(is_fk AS INT)) > 0.5 THEN 'links' WHEN avg(CAST(is_fk AS INT)) > 0.2 THEN 'mixed' ELSE 'entities' END AS cluster FROM cols GROUP BY 1")
def key_buckets(spark, sf_dir):
    return domains.foreign_key_buckets(order_catalog(spark, sf_dir)[0])


DOMAINS = "dom AS (SELECT DISTINCT table_name, 'D' || (k // 100) AS domain FROM cols), outer_rels AS (SELECT DISTINCT s.domain, target_table FROM rels JOIN dom s ON s.table_name = source_table JOIN dom t ON t.table_name = target_table WHERE s.domain <> t.domain)"


def _diagrams(spark, sf_dir):
    c, r = order_catalog(spark, sf_dir)
    m = c.select("table_name", F.concat(F.lit("D"), F.floor(F.col("k") / 100)).alias("domain")).distinct()
    return mermaid.parse(stage(mermaid.render(c, r, m).select(F.col("domain").alias("diagram"), "body"), "diagrams"))


@query("diagram_columns", f"WITH {CATALOG}, {DOMAINS} SELECT domain AS diagram, table_name, column_name, column_type, is_pk, is_fk FROM cols JOIN dom USING (table_name) UNION ALL SELECT domain, target_table, 'id', 'int', true, false FROM outer_rels")
def diagram_columns(spark, sf_dir):
    return _diagrams(spark, sf_dir)["columns"].drop("ordinal")


@query("diagram_relationships", f"WITH {CATALOG}, {DOMAINS} SELECT domain AS diagram, source_table, min(source_column) AS source_column, target_table, 'many-to-one' AS cardinality FROM rels JOIN dom ON table_name = source_table GROUP BY ALL")
def diagram_relationships(spark, sf_dir):
    return _diagrams(spark, sf_dir)["relationships"].drop("target_column")


@query("cardinalities", """WITH s AS (SELECT ['}o--||', '||--o{', '}|--|{', '||--||', '|o..o{'][l_linenumber % 5 + 1] AS symbol FROM lineitem)
    SELECT symbol, CASE symbol WHEN '}o--||' THEN 'many-to-one' WHEN '||--o{' THEN 'one-to-many' WHEN '}|--|{' THEN 'many-to-many' WHEN '||--||' THEN 'one-to-one' ELSE 'one-to-many' END AS cardinality, count(*) AS n FROM s GROUP BY 1, 2""")
def cardinalities(spark, sf_dir):
    symbol = F.element_at(F.array(*map(F.lit, ["}o--||", "||--o{", "}|--|{", "||--||", "|o..o{"])), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select(symbol.alias("symbol")).groupBy("symbol", patterns.cardinality(F.col("symbol")).alias("cardinality")).agg(F.count("*").alias("n"))


LINKS = f"{CATALOG}, edges AS (SELECT source_table AS src, target_table AS dst FROM rels WHERE source_table <> target_table), nodes AS (SELECT DISTINCT unnest([src, dst]) AS node FROM edges)"
CENTRAL_ROUNDS = 6
_CENTRALITY = _rounds_sql(
    "SELECT node, CAST(1.0 AS DOUBLE) AS centrality FROM nodes",
    "SELECT b.node, 0.15 + 0.85 * coalesce(got, 0) AS centrality FROM {r} b LEFT JOIN (SELECT e.dst AS node, sum(s.centrality / d.out_degree) AS got FROM {r} s JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = s.node JOIN deg d ON d.node = s.node GROUP BY 1) g ON b.node = g.node",
    CENTRAL_ROUNDS, "centrality", LINKS, 9)
DEPENDENCY = _CENTRALITY[: _CENTRALITY.rindex(" SELECT node, round(")] + f""", dn AS (SELECT deg.node, degree, {_importance('deg.node')} AS importance, centrality, out_degree >= 2 AND in_degree <= 1 AS jn, in_degree,
        {HAS('deg.node', 'type', 'status', 'category', 'lookup')} OR ends_with(lower(deg.node), '_ref') AS rf FROM deg JOIN r{CENTRAL_ROUNDS} r ON r.node = deg.node),
    dh AS (SELECT *, degree >= 5 OR (importance >= 0.8 AND degree >= 3) OR centrality >= 2 AS is_hub, importance >= 0.7 AND in_degree >= 2 AS is_root FROM dn),
    dt AS (SELECT *, CASE WHEN is_hub THEN 'hub' WHEN jn THEN 'junction' WHEN rf THEN 'reference' ELSE 'entity' END AS node_type FROM dh)"""


@query("dependency_hubs", f"{DEPENDENCY} SELECT node, degree, importance, round(centrality + 1e-9, 6) AS centrality, is_hub, is_root, node_type FROM dt")
def dependency_hubs(spark, sf_dir):
    return hubs.dependency_hubs(_links(spark, sf_dir), rounds=CENTRAL_ROUNDS, tolerance=0.0).withColumn("centrality", F.round(F.col("centrality") + 1e-9, 6))


def _links(spark, sf_dir):
    return stage(order_links(spark, sf_dir), "links")


_K = _kinds("src", "dst")


@query("dependency_domains", f"""{DEPENDENCY}, e AS (SELECT DISTINCT src, dst FROM edges), und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e),
    core AS (SELECT src AS hub, dst AS node FROM e JOIN dt h ON h.node = src JOIN dt t ON t.node = dst WHERE h.is_hub AND t.node_type <> 'reference' AND ({_K['kind']} = 'composition' OR {_K['nature']} = 'core')),
    look AS (SELECT src AS hub, dst AS node FROM e JOIN dt h ON h.node = src JOIN dt t ON t.node = dst WHERE h.is_hub AND t.node_type = 'reference'),
    sup AS (SELECT DISTINCT hub, e.dst AS node FROM core JOIN e ON e.src = core.node JOIN dt t ON t.node = e.dst WHERE (t.importance >= 0.6 OR t.centrality >= 1.5) AND t.node_type <> 'reference' AND e.dst <> hub AND NOT EXISTS (SELECT 1 FROM core c WHERE c.hub = core.hub AND c.node = e.dst)),
    mem AS (SELECT node AS hub, node, 'hub' AS part FROM dt WHERE is_hub UNION ALL SELECT hub, node, 'core' FROM core UNION ALL SELECT hub, node, 'supporting' FROM sup UNION ALL SELECT hub, node, 'lookup' FROM look),
    con AS (SELECT dst AS hub, src AS node FROM e JOIN dt h ON h.node = dst JOIN dt s ON s.node = src WHERE h.is_hub AND s.node_type <> 'junction'),
    size AS (SELECT hub, count(*) AS n, string_agg(node, ',' ORDER BY node) FILTER (part = 'core') AS core, string_agg(node, ',' ORDER BY node) FILTER (part = 'supporting') AS supporting, string_agg(node, ',' ORDER BY node) FILTER (part = 'lookup') AS lookup FROM mem GROUP BY 1), users AS (SELECT hub, count(*) AS k FROM con GROUP BY 1),
    ins AS (SELECT x.hub, count(*) AS i FROM mem x JOIN und ON a = x.node JOIN mem y ON y.hub = x.hub AND y.node = b GROUP BY 1), both_ways AS (SELECT a, b FROM und UNION ALL SELECT b, a FROM und),
    ext AS (SELECT x.hub, count(*) AS x FROM mem x JOIN both_ways ON a = x.node JOIN con y ON y.hub = x.hub AND y.node = b GROUP BY 1),
    s AS (SELECT size.*, coalesce(k, 0) AS n_consumers, CASE WHEN n <= 1 THEN 1.0 ELSE coalesce(i, 0) / (n * (n - 1) / 2) END AS cohesion, CASE WHEN coalesce(k, 0) = 0 THEN 0.0 ELSE coalesce(x, 0) / (n * k) END AS coupling FROM size LEFT JOIN users USING (hub) LEFT JOIN ins USING (hub) LEFT JOIN ext USING (hub))
    SELECT hub AS cluster, coalesce(core, '') AS core, coalesce(supporting, '') AS supporting, coalesce(lookup, '') AS lookup, n, n_consumers, round(cohesion, 6) AS cohesion, round(coupling, 6) AS coupling, round(0.7 * cohesion + 0.3 * (1 - coupling), 6) AS score FROM s WHERE cohesion >= 0.6 AND n <= 15""")
def dependency_domains(spark, sf_dir):
    e = _links(spark, sf_dir)
    d = clustering.dependency_domains(e, hubs.dependency_hubs(e, rounds=CENTRAL_ROUNDS, tolerance=0.0))
    return d.withColumns({**{c: F.array_join(c, ",") for c in ("core", "supporting", "lookup")}, **{c: F.round(c, 6) for c in ("cohesion", "coupling", "score")}})


@query("edge_extremes", """WITH seq AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem), edges AS (SELECT src, dst, count(*) AS weight FROM seq WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2)
    SELECT * FROM (SELECT 'strongest' AS kind, src, dst, weight FROM edges ORDER BY weight DESC, src, dst LIMIT 5) UNION ALL SELECT * FROM (SELECT 'weakest', src, dst, weight FROM edges ORDER BY weight, src, dst LIMIT 5)""")
def edge_extremes(spark, sf_dir):
    return hubs.extreme_edges(stage(part_sequence(spark, sf_dir), "parts"), 5)


@query("best_supplier", "SELECT l_partkey, l_suppkey, n FROM (SELECT l_partkey, l_suppkey, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1")
def best_supplier(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("n"))
    return clustering.best(n, ["l_partkey"], "n", "l_suppkey")


@query("text_rules", """
    WITH p AS (SELECT p_partkey AS k, ['inactive', 'Active', ' No', 'Disabled', 'yes', '1', 'ON', '0', NULL][p_partkey % 9 + 1] AS v, p_name || ' & ' || p_brand AS d, p_name || p_brand AS c, ['col' || p_partkey || ' -> id' || p_size, 'fk ref' || p_size, 'none'][p_partkey % 3 + 1] AS r, 'see ```sql SELECT ' || p_size || ' ``` ' || p_name AS q FROM part)
    SELECT k, coalesce(lower(trim(v)) IN ('inactive', 'disabled', 'false', '0', 'no', 'n'), false) AS inactive, coalesce(lower(trim(v)) IN ('true', 'yes', '1', 'y', 'on'), false) AS truthy, substring(regexp_replace(regexp_replace(lower(d), '[^a-z0-9\\s]', '', 'g'), '\\s+', '_', 'g'), 1, 50) AS domain,
        trim(regexp_replace(c, '([A-Z])', ' \\1', 'g')) AS words, CASE k % 3 WHEN 0 THEN regexp_extract(r, '^\\w+') WHEN 1 THEN regexp_extract(r, '\\w+$') END AS source, CASE k % 3 WHEN 0 THEN regexp_extract(r, '\\w+$') END AS target, regexp_extract(q, 'SELECT \\d+') AS block FROM p""".replace("\\\\", "\\"))
def text_rules(spark, sf_dir):
    k = F.col("p_partkey")
    v = F.element_at(F.array(*[F.lit(x) for x in ["inactive", "Active", " No", "Disabled", "yes", "1", "ON", "0"]], F.lit(None)), (k % 9 + 1).cast("int"))
    r = F.when(k % 3 == 0, F.concat(F.lit("col"), k, F.lit(" -> id"), "p_size")).when(k % 3 == 1, F.concat(F.lit("fk ref"), "p_size")).otherwise("none")
    a = text.arrow_description(r)
    return read(spark, sf_dir, "part").select(
        k.alias("k"), F.coalesce(text.is_inactive(v), F.lit(False)).alias("inactive"), text.is_truthy(v).alias("truthy"), text.domain_key(F.concat("p_name", F.lit(" & "), "p_brand")).alias("domain"), text.camel_words(F.concat("p_name", "p_brand")).alias("words"),
        a["source"].alias("source"), a["target"].alias("target"), text.sql_block(F.concat(F.lit("see ```sql SELECT "), "p_size", F.lit(" ``` "), "p_name")).alias("block"),
    )
