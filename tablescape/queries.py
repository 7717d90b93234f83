"""The registered queries of the engine's own operators, with the SQL that checks them.

Every query reads the given tables whole; graphs and catalogs are derived from
them by Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.functions import stats, text, vectors
from tablescape.operators import cascade, clustering, events, gap, graph, hubs, linkage, louvain, patterns, reach, similarity, spectral, validation, weights
from tablescape.plans import spec as plans
from tablescape.session import stage
from tablescape.sources import catalog, mermaid
from tablescape.sources.catalog import FOREIGN_KEYS, part_sequence, read, supply_graph, trade_graph
from tablescape.streaming import limits

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) as query ``name``; ``sql`` gives the same rows in DuckDB."""

    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


# The derived graphs in SQL.
TRADE = """
    flow AS (SELECT c_nationkey, s_nationkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
    named AS (SELECT a.n_name AS src, b.n_name AS dst, cents FROM flow JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey),
    edges AS (SELECT src, dst, cents, round(cents / max(cents) OVER (PARTITION BY src), 6) AS weight FROM named
        QUALIFY cents * count(*) OVER (PARTITION BY src) >= sum(cents) OVER (PARTITION BY src)),
    nodes AS (SELECT DISTINCT unnest([src, dst]) AS node FROM edges)"""
PARTS = """
    seq AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem),
    edges AS (SELECT src, dst, count(*) AS weight FROM seq WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
    und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges)"""
SUPPLY = "edges AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY 1, 2)"
DEGREES = """
    ends AS (SELECT src AS node, dst AS other, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, src, 0, 1 FROM edges),
    deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) + sum(o) AS BIGINT) AS degree, count(DISTINCT CASE WHEN other <> node THEN other END) AS n_neighbours FROM ends GROUP BY node)"""


# --- specifications, joins, filters -----------------------------------------------------------


@query("spec_join_path_revenue", """
    SELECT r_name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n_lines
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE l_discount BETWEEN 0.02 AND 0.08 AND l_returnflag <> 'R' GROUP BY r_name""")
def spec_join_path_revenue(spark, sf_dir):
    spec = plans.QuerySpec(
        tables=["lineitem", "region"], joins=plans.join_path("lineitem", "region", FOREIGN_KEYS),
        conditions=[plans.Condition("l_discount", "BETWEEN", (0.02, 0.08)), plans.Condition("l_returnflag", "!=", "R")],
        group_by=["r_name"], aggregates={"cents": ("sum", "cast(round(l_extendedprice * 100) as bigint)"), "n_lines": ("count", "*")}, order_by=[("cents", "DESC")],
    )
    return plans.execute(spec, {t: read(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region")})


@query("spec_filters_in_between_like", """
    SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_name LIKE '%bolt' AND p_type IN ('ECONOMY', 'PROMO') AND p_size BETWEEN 10 AND 40 AND p_brand <> 'Brand#3' AND p_retailprice >= 900""")
def spec_filters(spark, sf_dir):
    c = plans.Condition
    return plans.execute(plans.QuerySpec(["part"], ["p_partkey", "p_name", "p_brand", "p_size"], conditions=[c("p_name", "LIKE", "%bolt"), c("p_type", "IN", ["ECONOMY", "PROMO"]), c("p_size", "BETWEEN", (10, 40)), c("p_brand", "!=", "Brand#3"), c("p_retailprice", ">=", 900.0)]), {"part": read(spark, sf_dir, "part")})


@query("spec_outer_joins", """
    SELECT o_orderpriority, count(*) AS n, count(c_custkey) AS n_customers FROM orders FULL JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority""")
def spec_outer_joins(spark, sf_dir):
    s = plans.QuerySpec(["orders", "customer"], joins=[plans.Join("orders", "o_custkey", "customer", "c_custkey", "full")], group_by=["o_orderpriority"], aggregates={"n": ("count", "*"), "n_customers": ("count", "c_custkey")})
    return plans.execute(s, {"orders": read(spark, sf_dir, "orders"), "customer": read(spark, sf_dir, "customer")})


@query("tenant_scoped_orders", """
    SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'""")
def tenant_scoped_orders(spark, sf_dir):
    scope = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation").where(F.col("n_name") == "NATION_3"), F.col("c_nationkey") == F.col("n_nationkey"))
    return read(spark, sf_dir, "orders").join(scope, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_name", "n_name")


@query("member_listing", """
    SELECT n_name, c_name, c_acctbal, CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank
    FROM customer JOIN nation ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) <= 5""")
def member_listing(spark, sf_dir):
    j = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return clustering.ranked_top(j, ["n_name"], "c_acctbal", 5, "c_custkey").select("n_name", "c_name", "c_acctbal", "rank")


@query("role_threshold", """
    SELECT conv_id, count(*) AS n, count(*) FILTER (CASE role WHEN 'system' THEN 4 WHEN 'assistant' THEN 3 WHEN 'user' THEN 1 ELSE 0 END >= 3) AS n_trusted FROM conversations GROUP BY conv_id""")
def role_threshold(spark, sf_dir):
    rank = F.create_map(*[F.lit(x) for p in (("system", 4), ("assistant", 3), ("user", 1)) for x in p])
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(rank[F.col("role")], F.lit(0)) >= 3).alias("n_trusted"))


@query("link_validity", """
    SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F' AND o_orderdate + INTERVAL 3 YEAR >= TIMESTAMP '2000-01-01' AND (o_totalprice IS NULL OR o_totalprice < 300000)) AS n_valid FROM orders GROUP BY 1""")
def link_validity(spark, sf_dir):
    ok = (F.col("o_orderstatus") != "F") & (F.col("o_orderdate") + F.expr("INTERVAL 3 YEARS") >= F.expr("TIMESTAMP_NTZ '2000-01-01'")) & (F.col("o_totalprice").isNull() | (F.col("o_totalprice") < 300000))
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


@query("orphan_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def orphan_anti_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_totalprice > 250000").select("o_custkey")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("semi_known", "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def semi_known(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_partkey")
    return read(spark, sf_dir, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("fuzzy_match_top1", """
    WITH n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT DISTINCT regexp_extract(p_name, '\\w+$') || ' ' || regexp_extract(p_name, '^\\w+') AS candidate FROM part),
    j AS (SELECT name, candidate, jaro_similarity(name, candidate) AS j, CASE WHEN name[1:4] = candidate[1:4] THEN 4 WHEN name[1:3] = candidate[1:3] THEN 3 WHEN name[1:2] = candidate[1:2] THEN 2 WHEN name[1] = candidate[1] THEN 1 ELSE 0 END AS l FROM n, c),
    p AS (SELECT name, candidate, CASE WHEN name = candidate THEN 1.0 ELSE j + l * 0.1 * (1 - j) END AS s FROM j)
    SELECT name, candidate, round(s, 6) AS similarity FROM p WHERE s >= 0.7 QUALIFY row_number() OVER (PARTITION BY name ORDER BY s DESC, candidate) = 1""".replace("\\\\", "\\"))
def fuzzy_match_top1(spark, sf_dir):
    from tablescape.sources.dictionary import match_names

    p = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    c = p.select(F.concat(F.regexp_extract("name", r"\w+$", 0), F.lit(" "), F.regexp_extract("name", r"^\w+", 0)).alias("candidate")).distinct()
    return match_names(p, c).withColumn("similarity", F.round("similarity", 6))


@query("entity_search", """
    SELECT 'customer' AS kind, c_name AS name FROM customer WHERE contains(lower(c_name), '77') UNION SELECT 'supplier', s_name FROM supplier WHERE contains(lower(s_name), '77') UNION SELECT 'part', p_name FROM part WHERE contains(lower(p_name), 'red')""")
def entity_search(spark, sf_dir):
    find = lambda t, c, q: read(spark, sf_dir, t).where(F.lower(c).contains(q)).select(F.lit(t).alias("kind"), F.col(c).alias("name"))
    return find("customer", "c_name", "77").unionByName(find("supplier", "s_name", "77")).unionByName(find("part", "p_name", "red")).distinct()


@query("page_of_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_of_orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("set_difference", """
    SELECT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45""")
def set_difference(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    a = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("partkey")).distinct()
    return a.join(li.where("l_returnflag = 'A' AND l_quantity > 45").select(F.col("l_partkey").alias("partkey")), "partkey", "left_anti")


@query("backfill_join", """
    SELECT n_name, o_orderstatus, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def backfill_join(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"))


@query("revenue_cube", """
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 10""")
def revenue_cube(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.count("*").alias("n")).where("n > 10")


# --- windows and statistics -------------------------------------------------------------------


@query("latest_per_group", """
    SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_group(spark, sf_dir):
    return clustering.latest(read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderdate")


@query("last_n_messages", """
    SELECT conv_id, turn, role, substring(text, 1, 300) AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8""")
def last_n_messages(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(spark, sf_dir, "conversations").withColumn("at", F.row_number().over(w)).where("at <= 8").select("conv_id", "turn", "role", F.substring("text", 1, 300).alias("text"))


@query("percentile_linear", """
    SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.8) + 1e-7, 3) AS p80, round(quantile_cont(o_totalprice, 0.85) + 1e-7, 3) AS p85, round(quantile_cont(o_totalprice, 0.95) + 1e-7, 3) AS p95 FROM orders GROUP BY 1""")
def percentile_linear(spark, sf_dir):
    p = stats.percentiles_linear(read(spark, sf_dir, "orders"), "o_totalprice", [0.8, 0.85, 0.95], ["o_orderpriority"])
    return p.withColumns({c: F.round(F.col(c) + 1e-7, 3) for c in ("p80", "p85", "p95")})


@query("percentile_floor_index", """
    WITH s AS (SELECT l_returnflag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, max(CASE WHEN i = floor(n * 10 / 100) THEN v END) AS p10, max(CASE WHEN i = floor(n * 25 / 100) THEN v END) AS p25, max(CASE WHEN i = floor(n * 50 / 100) THEN v END) AS p50,
        max(CASE WHEN i = floor(n * 75 / 100) THEN v END) AS p75, max(CASE WHEN i = floor(n * 90 / 100) THEN v END) AS p90 FROM s GROUP BY 1""")
def percentile_floor_index(spark, sf_dir):
    return stats.percentiles_by_index(read(spark, sf_dir, "lineitem"), "l_quantity", [10, 25, 50, 75, 90], ["l_returnflag"])


@query("weight_stats_bins", """
    SELECT l_linestatus, count(w) AS n, round(avg(w), 6) AS mean, min(w) AS least, max(w) AS most, round(var_pop(w), 6) AS variance, count(*) FILTER (w < 0.2) AS very_low, count(*) FILTER (w >= 0.2 AND w < 0.4) AS low,
        count(*) FILTER (w >= 0.4 AND w < 0.6) AS medium, count(*) FILTER (w >= 0.6 AND w < 0.8) AS high, count(*) FILTER (w >= 0.8) AS very_high
    FROM (SELECT l_linestatus, l_discount * 10 AS w FROM lineitem) GROUP BY 1""")
def weight_stats_bins(spark, sf_dir):
    return stats.weight_statistics(read(spark, sf_dir, "lineitem"), F.col("l_discount") * 10, ["l_linestatus"]).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 6)})


@query("size_outliers", """
    WITH s AS (SELECT avg(n_chars) AS mean, stddev_pop(n_chars) AS deviation FROM documents)
    SELECT round(mean, 4) AS mean, round(deviation, 4) AS deviation, count(*) FILTER (abs(n_chars - mean) > 2 * deviation) AS outliers, count(n_chars) AS n, round(deviation / mean, 6) AS variation FROM documents, s GROUP BY mean, s.deviation""")
def size_outliers(spark, sf_dir):
    d = stats.positive_negative_outliers(read(spark, sf_dir, "documents"), "n_chars")
    return d.withColumns({"mean": F.round("mean", 4), "deviation": F.round("deviation", 4), "variation": F.round("variation", 6)})


@query("rolling_mean", """
    SELECT event_id, user_id, avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS rolling FROM events""")
def rolling_mean(spark, sf_dir):
    return events.rolling_mean(read(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint")), "user_id", "cents", ["ts", "event_id"]).select("event_id", "user_id", "rolling")


# --- events -----------------------------------------------------------------------------------


@query("event_severity_counts", """
    SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'click') AS click,
        count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'purchase') AS purchase FROM events WHERE ts >= TIMESTAMP '2024-01-20'""")
def event_severity_counts(spark, sf_dir):
    return events.metrics(read(spark, sf_dir, "events"), F.expr("TIMESTAMP_NTZ '2024-01-20'"))


@query("event_metrics_topk", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def event_metrics_topk(spark, sf_dir):
    return events.top_counts(read(spark, sf_dir, "events"), "user_id", 10)


@query("trailing_counts_per_key", """
    SELECT DISTINCT user_id, event_type, ts, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) AS "trailing" FROM events""")
def trailing_counts_per_key(spark, sf_dir):
    return events.trailing_counts(read(spark, sf_dir, "events"), ["user_id", "event_type"], 86400).select("user_id", "event_type", "ts", "trailing")


@query("trailing_alerts_per_key", """
    SELECT DISTINCT user_id, ts, "trailing" FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '172799999999 microseconds' PRECEDING AND CURRENT ROW) AS "trailing" FROM events WHERE event_type = 'error') WHERE "trailing" >= 3""")
def trailing_alerts_per_key(spark, sf_dir):
    return events.alerts(read(spark, sf_dir, "events"), "error", 3, 172800, ["user_id"])


@query("tumbling_rate_limit", """
    WITH w AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start FROM events)
    SELECT user_id, window_start, count(*) AS n, least(count(*), 3) AS admitted, greatest(count(*) - 3, 0) AS rejected, greatest(3 - count(*), 0) AS remaining FROM w GROUP BY 1, 2""")
def tumbling_rate_limit(spark, sf_dir):
    return events.fixed_windows(read(spark, sf_dir, "events"), "user_id", 86400, 3)


@query("admitted_events", """
    WITH w AS (SELECT event_id, user_id, ts, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) <= 3 AS admitted FROM w)
    SELECT event_id, admitted, CASE WHEN NOT admitted THEN CAST(ceil(window_start + 86400 - epoch_us(ts) / 1000000) AS BIGINT) END AS retry_after FROM r""")
def admitted_events(spark, sf_dir):
    return events.admitted(read(spark, sf_dir, "events"), "user_id", 86400, 3, ["ts", "event_id"]).select("event_id", "admitted", "retry_after")


@query("retention_split", """
    SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS kept, count(*) FILTER (ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS dropped FROM events GROUP BY 1""")
def retention_split(spark, sf_dir):
    r = events.retention(read(spark, sf_dir, "events"), F.expr("TIMESTAMP_NTZ '2024-01-31'"), 7)
    return r.groupBy("event_type").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@query("session_activity", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_activity(spark, sf_dir):
    return events.sessions(read(spark, sf_dir, "events"), "user_id", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sliding_activity", """
    WITH e AS (SELECT event_type, epoch(ts) AS t FROM events), w AS (SELECT event_type, t, unnest([CAST(floor(t / 21600) * 21600 - k * 21600 AS BIGINT) for k in range(4)]) AS s FROM e)
    SELECT event_type, CAST(make_timestamp(s * 1000000) AS TIMESTAMP) AS "start", count(*) AS n FROM w WHERE t < s + 86400 GROUP BY 1, 2""")
def sliding_activity(spark, sf_dir):
    return events.sliding_counts(read(spark, sf_dir, "events"), "event_type", "24 hours", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_properties", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY 1")
def event_properties(spark, sf_dir):
    p = read(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return p.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count_distinct("p.k").alias("kinds"))


# The state of each key as its events come, a step a row.
_STEPS = "e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1000000 AS t, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query("penalty_rate_limit", f"""
    WITH RECURSIVE {_STEPS}, s AS (
        SELECT key, event_id, CAST(NULL AS DOUBLE) AS t, CAST(0 AS BIGINT) AS n, CAST(-1 AS DOUBLE) AS start, 0 AS count, 0 AS violations, CAST(0 AS DOUBLE) AS last, CAST(1 AS DOUBLE) AS factor, true AS admitted, 0 AS effective FROM e WHERE n = 1
        UNION ALL
        SELECT key, event_id, t, n, win, CASE WHEN ok THEN had + 1 ELSE had END, CASE WHEN ok THEN violations ELSE worse END, CASE WHEN ok THEN last ELSE t END, CASE WHEN ok THEN factor ELSE least(3.0, 1 + worse * CAST(0.5 AS DOUBLE)) END, ok, effective
        FROM (SELECT *, had < effective AS ok, greatest(0, violations - CASE WHEN last <> 0 AND t - last > 172800 THEN 1 ELSE 0 END) + 1 AS worse
              FROM (SELECT e.key, e.event_id, e.t, e.n, floor(e.t / 86400) * 86400 AS win, CASE WHEN floor(e.t / 86400) * 86400 = s.start THEN s.count ELSE 0 END AS had,
                           greatest(1, CAST(floor(3 / s.factor) AS INTEGER)) AS effective, s.violations, s.last, s.factor FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)))
    SELECT key, event_id, t, admitted, CAST(effective AS BIGINT) AS effective, CAST(violations AS BIGINT) AS violations FROM s WHERE n > 0""")
def penalty_rate_limit(spark, sf_dir):
    return limits.fold(read(spark, sf_dir, "events"), limits.Penalty(limit=3, window=86400.0, decay=172800.0), "user_id")


@query("token_bucket", f"""
    WITH RECURSIVE {_STEPS}, s AS (
        SELECT key, event_id, t, n, CAST(3 AS DOUBLE) AS had FROM e WHERE n = 1
        UNION ALL
        SELECT e.key, e.event_id, e.t, e.n, least(CAST(3 AS DOUBLE), CASE WHEN had >= 1 THEN had - 1 ELSE had END + greatest(CAST(0 AS DOUBLE), e.t - s.t) * (CAST(1 AS DOUBLE) / 20000)) FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
    SELECT key, event_id, t, had >= 1 AS admitted, CASE WHEN had >= 1 THEN had - 1 ELSE had END AS tokens, CASE WHEN had >= 1 THEN CAST(0 AS DOUBLE) ELSE (1 - had) / (CAST(1 AS DOUBLE) / 20000) END AS wait FROM s""")
def token_bucket(spark, sf_dir):
    return limits.fold(read(spark, sf_dir, "events"), limits.Bucket(capacity=3.0, rate=1 / 20000), "user_id")


@query("circuit_breaker", f"""
    WITH RECURSIVE {_STEPS}, s AS (
        SELECT key, event_id, CAST(NULL AS DOUBLE) AS t, CAST(0 AS BIGINT) AS n, 'CLOSED' AS state, 0 AS run, CAST(0 AS DOUBLE) AS opened, true AS admitted FROM e WHERE n = 1
        UNION ALL
        SELECT key, event_id, t, n, CASE WHEN NOT free THEN 'OPEN' WHEN NOT fails THEN 'CLOSED' WHEN state = 'OPEN' OR run + 1 >= 2 THEN 'OPEN' ELSE 'CLOSED' END,
               CASE WHEN NOT free THEN run WHEN NOT fails THEN 0 ELSE run + 1 END, CASE WHEN NOT free THEN opened WHEN fails AND (state = 'OPEN' OR run + 1 >= 2) THEN t ELSE 0 END, free
        FROM (SELECT e.key, e.event_id, e.t, e.n, s.state, s.run, s.opened, e.event_type = 'error' AS fails, NOT (s.state = 'OPEN' AND e.t - s.opened < 86400) AS free FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1))
    SELECT key, event_id, t, state, admitted FROM s WHERE n > 0""")
def circuit_breaker(spark, sf_dir):
    return limits.fold(read(spark, sf_dir, "events"), limits.Breaker(failures=2, rest=86400.0), "user_id", F.when(F.col("event_type") == "error", -1.0).otherwise(1.0))


@query("windowed_alerts", """
    SELECT user_id, CAST(make_timestamp(CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) * 1000000) AS TIMESTAMP) AS "start", count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2""")
def windowed_alerts(spark, sf_dir):
    return limits.windowed_alerts(read(spark, sf_dir, "events"), "error", "user_id", 2, "24 hours", "24 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- catalog ----------------------------------------------------------------------------------


def _profile_sql() -> str:
    cols = {
        "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
        "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    }
    kinds = {"r_name": "string", "n_name": "string", "c_name": "string", "c_acctbal": "numeric", "c_mktsegment": "string", "s_name": "string", "s_acctbal": "numeric", "p_name": "string", "p_brand": "string", "p_type": "string", "p_retailprice": "numeric", "o_orderstatus": "string", "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "string"}
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, '{kinds.get(c, 'integer')}' AS type_class, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}" for t, cs in cols.items() for i, c in enumerate(cs))


@query("catalog_profile", _profile_sql())
def catalog_profile(spark, sf_dir):
    names = ["region", "nation", "customer", "supplier", "part", "orders"]
    return catalog.profile({t: read(spark, sf_dir, t) for t in names}).select("table_name", "ordinal", "column_name", "type_class", "n_rows", "n_nulls")


@query("key_statistics", " UNION ALL ".join(f"""
    SELECT '{st}' AS source_table, '{sc}' AS source_column, '{tt}' AS target_table, '{tc}' AS target_column, (SELECT count(*) FROM {st}) AS n_rows, (SELECT count(*) FROM {st} WHERE {sc} IS NULL) AS n_null,
        (SELECT count(DISTINCT {sc}) FROM {st}) AS n_keys, (SELECT count(DISTINCT {tc}) FROM {tt} WHERE {tc} NOT IN (SELECT {sc} FROM {st} WHERE {sc} IS NOT NULL)) AS unused_targets,
        (SELECT count(DISTINCT {sc}) FROM {st} WHERE {sc} NOT IN (SELECT {tc} FROM {tt} WHERE {tc} IS NOT NULL)) AS orphan_keys, (SELECT max(n) FROM (SELECT count(*) AS n FROM {st} WHERE {sc} IS NOT NULL GROUP BY {sc})) AS most_rows""" for st, sc, tt, tc in FOREIGN_KEYS))
def key_statistics(spark, sf_dir):
    return catalog.key_statistics(spark, sf_dir)


def _inclusion_sql() -> str:
    cols = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("supplier", "s_suppkey"), ("supplier", "s_nationkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("lineitem", "l_linenumber"), ("part", "p_partkey"), ("part", "p_size")]
    v = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS BIGINT) AS v, count(*) AS n FROM {t} GROUP BY {c}" for t, c in cols)
    return f"""WITH v AS ({v}), s AS (SELECT t, c, count(v) AS d, max(n) AS most, count(*) FILTER (v IS NULL) AS nulls FROM v GROUP BY 1, 2),
        p AS (SELECT a.t AS st, a.c AS sc, b.t AS tt, b.c AS tc, count(*) AS shared FROM v a JOIN v b ON a.v = b.v AND a.t <> b.t GROUP BY ALL)
        SELECT st AS source_table, sc AS source_column, tt AS target_table, tc AS target_column, shared / s.d AS share FROM p JOIN s ON st = s.t AND sc = s.c JOIN s k ON tt = k.t AND tc = k.c WHERE k.most = 1 AND k.nulls = 0 AND shared >= s.d"""


@query("discovered_keys", _inclusion_sql())
def discovered_keys(spark, sf_dir):
    return catalog.discover_keys({t: read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "part")})


# --- text functions ---------------------------------------------------------------------------


@query("sanitized_names", """
    SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9_]', '_', 'g') AS identifier, regexp_replace(lower(trim(p_name)), '\\s+', '_', 'g') AS header, upper(p_name[1]) || p_name[2:] AS business, regexp_replace(p_brand, '[<>:"/|?*#]', '_', 'g') AS file FROM part""".replace("\\\\", "\\"))
def sanitized_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.sanitize_identifier(F.col("p_name")).alias("identifier"), text.normalize_header(F.col("p_name")).alias("header"), text.business_name(F.col("p_name")).alias("business"), F.regexp_replace(text.sanitize_filename(F.col("p_brand")), "#", "_").alias("file"))


@query("redacted_messages", """
    SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'Unknown error' WHEN regexp_matches(lower(text), 'password|secret|token|key|auth|credential|connection string|database|sql') THEN 'Internal system error - details withheld for security'
        ELSE substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '/Users/[^/]+/[^\\s]+', '[REDACTED_PATH]', 'g'), '/home/[^/]+/[^\\s]+', '[REDACTED_PATH]', 'g'), 'C:\\\\[^\\s]+', '[REDACTED_PATH]', 'g'), 'at [^\\s]+ \\([^)]+\\)', 'at [REDACTED_FUNCTION]', 'g'), 1, 200) END AS message FROM documents""")
def redacted_messages(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.redact_error(F.col("text")).alias("message"))


@query("response_scores", """
    SELECT conv_id, turn, round(least(0.95, greatest(0.3, 0.7 + CASE WHEN contains(text, '```sql') THEN 0.1 ELSE 0 END + CASE WHEN contains(text, '**') OR contains(text, '##') THEN 0.05 ELSE 0 END + CASE WHEN length(text) > 500 THEN 0.1 ELSE 0 END - CASE WHEN contains(lower(text), 'might') OR contains(lower(text), 'possibly') THEN 0.1 ELSE 0 END)), 6) AS confidence,
        CASE WHEN len(regexp_extract_all(lower(text), 'join')) > 3 OR len(regexp_extract_all(lower(text), '\\(select')) > 1 THEN 'slow' WHEN len(regexp_extract_all(lower(text), 'join')) > 1 OR len(regexp_extract_all(lower(text), '\\(select')) > 0 OR regexp_matches(lower(text), 'count|sum|avg|max|min') THEN 'medium' ELSE 'fast' END AS speed FROM conversations""")
def response_scores(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(text.response_confidence(F.col("text")), 6).alias("confidence"), text.sql_speed(F.col("text")).alias("speed"))


@query("string_hashes", """
    SELECT c_custkey, abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: (((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648)) AS hash FROM customer""")
def string_hashes(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.string_hash(F.col("c_name")).alias("hash"))


@query("hash_embeddings", r"""
    WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, list_filter(regexp_split_to_array(lower(p_name), '\W+'), lambda x: length(x) > 2) AS w FROM n),
    e AS (SELECT p_name, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
    h AS (SELECT p_name, abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(word, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: (((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648)) % 64 AS dim, CAST(1 AS DOUBLE) / i AS x FROM e),
    s AS (SELECT p_name, dim, sum(x) AS x FROM h GROUP BY 1, 2)
    SELECT p_name, CAST(dim AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_name)), 6) AS x FROM s""")
def hash_embeddings(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_name").distinct()
    return p.select("p_name", F.explode(F.transform(text.hash_embedding(F.col("p_name"), 64), lambda x, i: F.struct(i.alias("dim"), F.round(x, 6).alias("x")))).alias("e")).select("p_name", "e.dim", "e.x").where("x <> 0")


@query("name_character_jaccard", """
    WITH n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT name, list_distinct(string_split(lower(name), '')) AS c FROM n)
    SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 6) AS jaccard FROM c a JOIN c b ON a.name < b.name""")
def name_character_jaccard(spark, sf_dir):
    n = read(spark, sf_dir, "part").select("p_name").distinct().select(F.col("p_name").alias("name"), text.characters(F.col("p_name")).alias("c"))  # few distinct names
    return n.alias("x").join(n.alias("y"), F.col("x.name") < F.col("y.name")).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.round(vectors.jaccard(F.col("x.c"), F.col("y.c")), 6).alias("jaccard"))


@query("type_distribution_distances", """
    WITH u AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS total FROM u GROUP BY 1), p AS (SELECT u.user_id, event_type, n / total AS p FROM u JOIN t USING (user_id)),
    q AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS q FROM events GROUP BY 1), ids AS (SELECT user_id, event_type, q FROM t, q), j AS (SELECT ids.user_id, coalesce(p, 0) AS p, q FROM ids LEFT JOIN p ON ids.user_id = p.user_id AND ids.event_type = p.event_type)
    SELECT user_id, round(sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)) / ln(2)), 6) AS js, round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 6) AS cosine FROM j GROUP BY 1""")
def type_distribution_distances(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("table_name"), F.col("event_type").alias("type_class"))
    all_ = patterns.type_distribution(e.withColumn("table_name", F.lit("all"))).select(F.col("shares").alias("all_shares"))
    d = patterns.type_distribution(e).crossJoin(F.broadcast(all_))  # one row
    return d.select(F.col("table_name").cast("bigint").alias("user_id"), F.round(vectors.jensen_shannon(F.col("shares"), F.col("all_shares")), 6).alias("js"), F.round(vectors.distribution_cosine(F.col("shares"), F.col("all_shares")), 6).alias("cosine"))


@query("brand_jaccard", """
    WITH b AS (SELECT DISTINCT s_nationkey AS n, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45), s AS (SELECT n, count(*) AS k FROM b GROUP BY 1),
    i AS (SELECT x.n AS a, y.n AS b, count(*) AS shared FROM b x JOIN b y ON x.p = y.p AND x.n < y.n GROUP BY 1, 2)
    SELECT a, b, round(shared / (x.k + y.k - shared), 6) AS jaccard FROM i JOIN s x ON a = x.n JOIN s y ON i.b = y.n""")
def brand_jaccard(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where("l_quantity >= 45").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    held = stage(li.select(F.col("s_nationkey").alias("n"), F.col("l_partkey").alias("p")).distinct(), "held")
    k = held.groupBy("n").agg(F.count("*").alias("k"))
    # a part's nations are 25 at most, so its pairs are bounded
    both = held.groupBy("p").agg(F.array_sort(F.collect_list("n")).alias("ns")).select(F.explode("ns").alias("a"), "ns").select("a", F.explode("ns").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    side = lambda c, n: k.select(F.col("n").alias(c), F.col("k").alias(n))
    return both.join(side("a", "ka"), "a").join(side("b", "kb"), "b").select("a", "b", F.round(F.col("both") / (F.col("ka") + F.col("kb") - F.col("both")), 6).alias("jaccard"))


# --- graphs -----------------------------------------------------------------------------------


@query("graph_degree", f"WITH {SUPPLY}, {DEGREES} SELECT * FROM deg")
def graph_degree(spark, sf_dir):
    return graph.degrees(supply_graph(spark, sf_dir))


@query("degree_histogram", f"WITH {PARTS}, {DEGREES} SELECT degree, count(*) AS n FROM deg GROUP BY 1")
def degree_histogram(spark, sf_dir):
    return graph.degrees(part_sequence(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("n"))


@query("graph_density", f"""WITH {PARTS}, {DEGREES} SELECT count(*) AS n_nodes, CAST(sum(degree) // 2 AS BIGINT) AS n_edges, round(avg(degree), 6) AS mean_degree, round(stddev_pop(degree), 6) AS degree_deviation,
    round(sum(degree) / 2 / (count(*) * (count(*) - 1) / 2), 9) AS density FROM deg""")
def graph_density(spark, sf_dir):
    d = graph.density(part_sequence(spark, sf_dir))
    return d.withColumns({"mean_degree": F.round("mean_degree", 6), "degree_deviation": F.round("degree_deviation", 6), "density": F.round("density", 9)})


@query("adjacency_list", f"WITH {TRADE} SELECT node, array_to_string(list_sort(list(other)), ',') AS others FROM (SELECT src AS node, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY node")
def adjacency_list(spark, sf_dir):
    return graph.adjacency(trade_graph(spark, sf_dir)).select("node", F.array_join("others", ",").alias("others"))


@query("connected_components", """
    SELECT DISTINCT 'C' || o_custkey AS node, 'C' || o_custkey AS component FROM orders UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders""")
def connected_components(spark, sf_dir):
    e = read(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("src"), F.concat(F.lit("C"), "o_custkey").alias("dst"))
    return graph.connected_components(e)


HOPS = f"""WITH RECURSIVE {TRADE}, near AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges),
    walk AS (SELECT node AS source, node, 0 AS hops FROM nodes UNION SELECT source, y, hops + 1 FROM walk JOIN near ON node = x WHERE hops < 6),
    hop AS (SELECT source, node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY 1, 2)"""


@query("bfs_hops", f"{HOPS} SELECT * FROM hop WHERE source = 'NATION_0'")
def bfs_hops(spark, sf_dir):
    e = stage(trade_graph(spark, sf_dir), "trade")
    return graph.bfs(e, e.select(F.lit("NATION_0").alias("source")).limit(1), most=6)


@query("path_metrics", f"{HOPS} SELECT max(hops) AS diameter, round(avg(hops), 6) AS mean_length, count(*) AS n_paths FROM hop WHERE hops > 0")
def path_metrics(spark, sf_dir):
    return graph.path_metrics(stage(trade_graph(spark, sf_dir), "trade"), most=6).withColumn("mean_length", F.round("mean_length", 6))


@query("betweenness", f"""{HOPS},
    paths AS (SELECT source, source AS node, 0 AS hops, 1 AS n FROM hop WHERE hops = 0 UNION ALL SELECT p.source, y, p.hops + 1, p.n FROM paths p JOIN near ON p.node = x JOIN hop h ON h.source = p.source AND h.node = y AND h.hops = p.hops + 1),
    sigma AS (SELECT source, node, sum(n) AS s FROM paths GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM nodes),
    b AS (SELECT v.node, sum(a.s * c.s / t.s) AS b FROM nodes v JOIN hop hv ON hv.node = v.node AND hv.source <> v.node JOIN hop hw ON hw.source = v.node AND hw.node <> v.node JOIN hop ht ON ht.source = hv.source AND ht.node = hw.node AND ht.hops = hv.hops + hw.hops AND ht.hops > 0
        JOIN sigma a ON a.source = hv.source AND a.node = v.node JOIN sigma c ON c.source = v.node AND c.node = hw.node JOIN sigma t ON t.source = ht.source AND t.node = ht.node GROUP BY 1)
    SELECT nodes.node, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM nodes LEFT JOIN b USING (node), n""")
def betweenness(spark, sf_dir):
    return graph.betweenness(stage(trade_graph(spark, sf_dir), "trade")).withColumn("betweenness", F.round("betweenness", 6))


TRIANGLES = """near AS (SELECT a AS x, b AS y FROM und UNION ALL SELECT b, a FROM und),
    tri AS (SELECT p.a AS n1, p.b AS n2, q.b AS n3 FROM und p JOIN und q ON p.b = q.a JOIN und r ON r.a = p.a AND r.b = q.b),
    tn AS (SELECT node, count(*) AS triangles FROM (SELECT unnest([n1, n2, n3]) AS node FROM tri) GROUP BY 1), dn AS (SELECT x AS node, count(*) AS n_neighbours FROM near GROUP BY 1),
    cc AS (SELECT node, n_neighbours, coalesce(triangles, 0) AS triangles, CASE WHEN n_neighbours >= 2 THEN coalesce(triangles, 0) / (n_neighbours * (n_neighbours - 1) / 2) ELSE 0 END AS coefficient FROM dn LEFT JOIN tn USING (node))"""


@query("clustering_coefficient", f"WITH {PARTS}, {TRIANGLES} SELECT node, n_neighbours, triangles, round(coefficient, 6) AS coefficient FROM cc")
def clustering_coefficient(spark, sf_dir):
    return graph.clustering_coefficient(stage(part_sequence(spark, sf_dir), "parts")).withColumn("coefficient", F.round("coefficient", 6))


@query("average_clustering", f"WITH {PARTS}, {TRIANGLES} SELECT round(avg(coefficient), 6) AS average, count(*) AS n FROM cc WHERE n_neighbours >= 2")
def average_clustering(spark, sf_dir):
    return graph.average_clustering(stage(part_sequence(spark, sf_dir), "parts")).withColumn("average", F.round("average", 6))


@query("cluster_transitivity", f"""WITH seq AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem),
    edges AS (SELECT DISTINCT src, dst, a.p_type AS cluster FROM seq JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE src <> dst AND a.p_type = b.p_type),
    und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), {TRIANGLES}
    SELECT p_type AS cluster, CAST(sum(triangles) / 3 AS BIGINT) AS triangles, CAST(sum(n_neighbours * (n_neighbours - 1) / 2) AS BIGINT) AS wedges, round(sum(triangles) / sum(n_neighbours * (n_neighbours - 1) / 2), 6) AS transitivity FROM cc JOIN part ON node = p_partkey GROUP BY 1""")
def cluster_transitivity(spark, sf_dir):
    m = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("cluster"))
    return graph.transitivity(stage(part_sequence(spark, sf_dir), "parts"), m).withColumn("transitivity", F.round("transitivity", 6))


def _rounds_sql(first: str, step: str, rounds: int, value: str, base: str = TRADE, digits: int = 6) -> str:
    """Rounds of an iteration as chained tables."""
    ctes = [f"r0 AS MATERIALIZED ({first})"] + [f"r{k + 1} AS MATERIALIZED ({step.format(r=f'r{k}')})" for k in range(rounds)]
    return f"WITH {base}, {DEGREES}, n AS (SELECT count(*) AS n FROM nodes), {', '.join(ctes)} SELECT node, round({value}, {digits}) AS {value} FROM r{rounds}"


def _rank_sql(rounds: int, compat: bool, base: str = TRADE, digits: int = 6) -> str:
    share = "degree" if compat else "out_degree"
    loose = "0" if compat else "coalesce((SELECT sum(rank) FROM {r} JOIN deg USING (node) WHERE out_degree = 0), 0)"
    got = f"SELECT e.dst AS node, sum(s.rank / d.{share}) AS got FROM {{r}} s JOIN edges e ON e.src = s.node JOIN deg d ON d.node = s.node GROUP BY 1"
    return _rounds_sql("SELECT node, CAST(1.0 AS DOUBLE) / n AS rank FROM nodes, n", f"SELECT b.node, (1 - 0.85) / n + 0.85 * (coalesce(got, 0) + {loose} / n) AS rank FROM {{r}} b LEFT JOIN ({got}) g ON b.node = g.node, n", rounds, "rank", base, digits)


@query("pagerank_standard", _rank_sql(20, False))
def pagerank_standard(spark, sf_dir):
    return graph.pagerank(stage(trade_graph(spark, sf_dir), "trade"), rounds=20, tolerance=0.0).withColumn("rank", F.round("rank", 6))


@query("pagerank_compat", _rank_sql(10, True))
def pagerank_compat(spark, sf_dir):
    return graph.pagerank(stage(trade_graph(spark, sf_dir), "trade"), rounds=10, tolerance=0.0, compat=True).withColumn("rank", F.round("rank", 6))


@query("part_pagerank", _rank_sql(10, False, f"{PARTS}, nodes AS (SELECT DISTINCT unnest([src, dst]) AS node FROM edges)", 9))
def part_pagerank(spark, sf_dir):
    return graph.pagerank(stage(part_sequence(spark, sf_dir), "parts"), rounds=10, tolerance=0.0).withColumn("rank", F.round("rank", 9))


@query("dependency_centrality", _rounds_sql(
    "SELECT node, CAST(1.0 AS DOUBLE) AS centrality FROM nodes",
    "SELECT b.node, 0.15 + 0.85 * coalesce(got, 0) AS centrality FROM {r} b LEFT JOIN (SELECT e.dst AS node, sum(s.centrality / d.out_degree) AS got FROM {r} s JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = s.node JOIN deg d ON d.node = s.node GROUP BY 1) g ON b.node = g.node", 12, "centrality"))
def dependency_centrality(spark, sf_dir):
    return graph.dependency_centrality(stage(trade_graph(spark, sf_dir), "trade"), rounds=12, tolerance=0.0).withColumn("centrality", F.round("centrality", 6))


@query("graph_cycles", f"""WITH RECURSIVE {TRADE}, walk AS (SELECT src AS source, dst AS node, 1 AS length FROM edges UNION SELECT source, dst, length + 1 FROM walk JOIN edges ON node = src WHERE length < 6 AND node <> source)
    SELECT source AS node, CAST(min(length) AS INTEGER) AS length FROM walk WHERE source = node GROUP BY 1""")
def graph_cycles(spark, sf_dir):
    return graph.cycles(stage(trade_graph(spark, sf_dir), "trade"), most=6)


@query("hub_detection")
def hub_detection(spark, sf_dir):
    return hubs.hub_scores(stage(trade_graph(spark, sf_dir), "trade"))


@query("sigma_hubs", f"WITH {SUPPLY}, {DEGREES}, l AS (SELECT greatest(avg(degree) + 2.5 * stddev_pop(degree), 5) AS l FROM deg) SELECT node, degree FROM deg, l WHERE degree >= l")
def sigma_hubs(spark, sf_dir):
    return hubs.sigma_hubs(graph.degrees(stage(supply_graph(spark, sf_dir), "supply")).select("node", "degree"))


TOP = "tops AS (SELECT dst AS node FROM edges GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 4)"


def _top_nodes(e: DataFrame, k: int = 4) -> DataFrame:
    return stage(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(k).select("node"), "tops")


@query("mediated_pairs", f"""WITH {TRADE}, {TOP}, b AS (SELECT src AS hub, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
    legs AS (SELECT hub, other, max(weight) AS w FROM b WHERE hub IN (FROM tops) AND other NOT IN (FROM tops) GROUP BY 1, 2),
    p AS (SELECT x.other AS a, y.other AS b, max(least(x.w, y.w) * 0.8) AS weight FROM legs x JOIN legs y ON x.hub = y.hub AND x.other < y.other GROUP BY 1, 2)
    SELECT a, b, round(weight, 6) AS weight FROM p WHERE NOT EXISTS (SELECT 1 FROM edges WHERE least(src, dst) = a AND greatest(src, dst) = b)""")
def mediated_pairs(spark, sf_dir):
    e = stage(trade_graph(spark, sf_dir), "trade")
    return hubs.mediated_pairs(e, _top_nodes(e)).withColumn("weight", F.round("weight", 6))


@query("canonical_edges", f"WITH {PARTS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS weight FROM edges GROUP BY 1, 2")
def canonical_edges(spark, sf_dir):
    return hubs.canonical(part_sequence(spark, sf_dir))


@query("hub_edge_limits", f"""WITH {SUPPLY}, r AS (SELECT src AS hub, dst AS other, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rk, count(*) OVER (PARTITION BY src) AS n FROM edges)
    SELECT hub, other, weight FROM r WHERE rk <= CASE WHEN CAST(substring(hub, 2) AS BIGINT) % 3 = 0 THEN least(5, ceil(n * 0.3)) WHEN CAST(substring(hub, 2) AS BIGINT) % 3 = 1 THEN least(10, ceil(n * 0.2)) ELSE least(8, ceil(n * 0.15)) END""")
def hub_edge_limits(spark, sf_dir):
    e = supply_graph(spark, sf_dir).select(F.col("src").alias("hub"), F.col("dst").alias("other"), "weight")
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("hub"), F.when(F.col("s_suppkey") % 3 == 0, "junction").when(F.col("s_suppkey") % 3 == 1, "lookup").otherwise("other").alias("hub_type"))
    return hubs.keep_top_per_hub(e, s).select("hub", "other", "weight")


@query("normalised_weights", f"WITH {PARTS}, s AS (SELECT min(weight) AS lo, max(weight) AS hi FROM edges) SELECT src, dst, round(CASE WHEN hi > lo THEN 0.1 + 0.9 * (weight - lo) / (hi - lo) ELSE 1 END, 6) AS weight FROM edges, s")
def normalised_weights(spark, sf_dir):
    return hubs.normalised(stage(part_sequence(spark, sf_dir), "parts")).withColumn("weight", F.round("weight", 6))


@query("dependency_weights", f"""WITH {TRADE}, near AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), pairs AS (SELECT a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON a.node < b.node),
    two AS (SELECT DISTINCT p.x AS a, q.y AS b FROM near p JOIN near q ON p.y = q.x)
    SELECT src, dst, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = pairs.src AND e.dst = pairs.dst) THEN 2.0 WHEN EXISTS (SELECT 1 FROM edges e WHERE e.dst = pairs.src AND e.src = pairs.dst) THEN 1.5 WHEN EXISTS (SELECT 1 FROM two WHERE a = src AND b = dst) THEN 1.2 ELSE 1.0 END AS dependency FROM pairs""")
def dependency_weights(spark, sf_dir):
    e = stage(trade_graph(spark, sf_dir), "trade")
    n = graph.nodes_of(e)  # 25 nations at most
    return weights.dependency_weight(n.select(F.col("node").alias("src")).join(n.select(F.col("node").alias("dst")), F.col("src") < F.col("dst")), e)


@query("ghost_references", f"""WITH {TRADE}, m AS (SELECT n_name AS t, r_name AS d FROM nation JOIN region ON n_regionkey = r_regionkey), {TOP},
    r AS (SELECT src, dst, a.d AS sd, b.d AS td FROM edges JOIN m a ON src = a.t JOIN m b ON dst = b.t WHERE a.d <> b.d),
    i AS (SELECT sd AS domain, dst AS table_name, td AS home, count(*) AS incoming FROM r GROUP BY ALL), o AS (SELECT td AS domain, src AS table_name, count(*) AS outgoing FROM r GROUP BY ALL),
    x AS (SELECT i.domain, i.table_name, home, incoming, incoming + 0.5 * coalesce(outgoing, 0) + CASE WHEN i.table_name IN (FROM tops) THEN 10 ELSE 0 END AS importance FROM i LEFT JOIN o ON i.domain = o.domain AND i.table_name = o.table_name)
    SELECT domain, table_name, home, incoming, CAST(importance AS DOUBLE) AS importance, CAST(row_number() OVER (PARTITION BY domain ORDER BY importance DESC, table_name) AS INTEGER) AS rank FROM x QUALIFY row_number() OVER (PARTITION BY domain ORDER BY importance DESC, table_name) <= 5""")
def ghost_references(spark, sf_dir):
    e = stage(trade_graph(spark, sf_dir), "trade")
    m = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("table_name"), F.col("r_name").alias("domain"))
    return mermaid.ghost_references(e.select(F.col("src").alias("source_table"), F.col("dst").alias("target_table")), m, _top_nodes(e))


@query("node_types", f"WITH {TRADE}, {DEGREES} SELECT node, CASE WHEN out_degree >= 2 AND in_degree <= 1 THEN 'junction' WHEN degree >= 5 THEN 'hub' ELSE 'entity' END AS node_type FROM deg")
def node_types(spark, sf_dir):
    return patterns.node_types(graph.degrees(stage(trade_graph(spark, sf_dir), "trade")))


# --- clustering and validation ----------------------------------------------------------------


@query("hub_seeded_assignment")
def hub_seeded_assignment(spark, sf_dir):
    e = stage(trade_graph(spark, sf_dir), "trade")
    return clustering.hub_seeded(e, _top_nodes(e))


@query("consolidated_domains")
def consolidated_domains(spark, sf_dir):
    e = stage(trade_graph(spark, sf_dir), "trade")
    return clustering.consolidate(stage(clustering.hub_seeded(e, _top_nodes(e)).select("node", "cluster"), "members"), e)


@query("structural_domains")
def structural_domains(spark, sf_dir):
    e = stage(trade_graph(spark, sf_dir), "trade")
    h = _top_nodes(e)
    d = clustering.structural_domains(stage(clustering.hub_seeded(e, h).select("node", "cluster"), "members"), e, h)
    return d.withColumns({"core": F.array_join("core", ","), "hubs": F.array_join("hubs", ",")})


@query("dependency_scores", f"""WITH {TRADE}, od AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), s AS (SELECT src, dst, 1.0 AS s FROM edges UNION ALL SELECT a.src, b.dst, 0.5 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst)
    SELECT s.src, dst, round(sum(s) / max(n), 6) AS score FROM s JOIN od ON s.src = od.src GROUP BY 1, 2""")
def dependency_scores(spark, sf_dir):
    return clustering.dependency_score(stage(trade_graph(spark, sf_dir), "trade")).withColumn("score", F.round("score", 6))


@query("hub_affinity")
def hub_affinity(spark, sf_dir):
    e = stage(trade_graph(spark, sf_dir), "trade")
    h = _top_nodes(e)
    return clustering.hub_affinity(e, h, clustering.hub_seeded(e, h).select("node", "cluster"))


@query("label_propagation")
def label_propagation(spark, sf_dir):
    return clustering.label_propagation(stage(trade_graph(spark, sf_dir), "trade"))


@query("spectral_clusters")
def spectral_clusters(spark, sf_dir):
    return spectral.spectral_clusters(stage(part_sequence(spark, sf_dir), "parts"), 4, blocks=8, tolerance=0.05)


@query("louvain_parts")
def louvain_parts(spark, sf_dir):
    return louvain.louvain(stage(part_sequence(spark, sf_dir), "parts"), least_gain=1e-3, most_rounds=12, most_levels=4)


@query("linkage_parts")
def linkage_parts(spark, sf_dir):
    """Merges of parts that follow each other, each of which must have followed all of the other's."""
    return linkage.average_linkage(linkage.inverse_weights(stage(part_sequence(spark, sf_dir), "parts"))).select("a", "b", "height", "n")


@query("neighbour_distances", """
    WITH d AS (SELECT a.vec_id AS node, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT node, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance) AS r FROM d) WHERE r = 5""")
def neighbour_distances(spark, sf_dir):
    return reach.neighbour_distances(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 6))


@query("gap_embeddings")
def gap_embeddings(spark, sf_dir):
    return gap.gap_curve(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", [1, 2, 4, 6, 8, 10, 12])


def _alike(spark, sf_dir, least):
    return stage(similarity.similar_pairs(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", least), "pairs")


@query("greedy_similar", """
    WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4),
    v AS (SELECT vec_id AS node, row_number() OVER (ORDER BY vec_id) AS i, list(b) FILTER (WHERE b IS NOT NULL) AS near FROM embeddings LEFT JOIN p ON a = vec_id GROUP BY vec_id),
    s AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS got, CAST([] AS BIGINT[]) AS taken
        UNION ALL
        SELECT i, CASE WHEN open THEN node END, CASE WHEN open THEN new ELSE CAST([] AS BIGINT[]) END, CASE WHEN open THEN list_concat(taken, new) ELSE taken END
        FROM (SELECT v.i, node, taken, NOT list_contains(taken, node) AS open, list_append(list_filter(coalesce(near, CAST([] AS BIGINT[])), lambda x: NOT list_contains(taken, x)), node) AS new FROM s JOIN v ON v.i = s.i + 1))
    SELECT unnest(got) AS node, leader FROM s WHERE len(got) >= 2""")
def greedy_similar(spark, sf_dir):
    return similarity.greedy_groups(_alike(spark, sf_dir, 0.4), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node")))


@query("cascade_embeddings")
def cascade_embeddings(spark, sf_dir):
    """Clusters of the vectors by the cascade, over pairs from a cosine of .3 on; edges are those from .4 on."""
    p = _alike(spark, sf_dir, 0.3)
    pairs = p.select("a", "b", (1 - F.col("similarity")).alias("distance"))
    edges = stage(p.where("similarity >= 0.4").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("similarity").alias("weight")), "edges")
    return cascade.cascade(pairs, edges, read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node")))[0].withColumn("cluster", F.col("cluster").cast("string"))


@query("similar_pairs", """
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
    WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.45""")
def similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.45).withColumn("similarity", F.round("similarity", 6))


@query("similarity_classes", """
    WITH p AS (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
    SELECT CASE WHEN s >= 0.85 THEN 'high' WHEN s >= 0.7 THEN 'medium' ELSE 'low' END AS class, count(*) AS n FROM p WHERE s >= 0.5 GROUP BY 1""")
def similarity_classes(spark, sf_dir):
    p = similarity.similar_pairs(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.5)
    return p.groupBy(similarity.similarity_class(F.col("similarity")).alias("class")).agg(F.count("*").alias("n"))


UNIT = "u AS (SELECT label AS cluster, vec_id, i AS dim, CAST(embedding[i] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
POINTS = "p AS (SELECT label AS cluster, vec_id, i AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), n AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1), c AS (SELECT cluster, dim, avg(x) AS c FROM p GROUP BY 1, 2)"


@query("cluster_coherence", f"""WITH {UNIT}, n AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT cluster, sum(s * s) AS ss FROM (SELECT cluster, dim, sum(x) AS s FROM u GROUP BY 1, 2) GROUP BY 1),
    m AS (SELECT cluster, n, (ss - n) / (n * (n - 1)) AS m FROM n JOIN s USING (cluster)), a AS (SELECT avg(m) AS av, stddev_pop(m) AS d FROM m)
    SELECT cluster, n, round(m, 6) AS mean_similarity, CASE WHEN m < av - d THEN 'split' WHEN m < av THEN 'refine' WHEN m > av + d THEN 'merge' ELSE 'accept' END AS action FROM m, a""")
def cluster_coherence(spark, sf_dir):
    return similarity.coherence(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding").withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("silhouette", f"""WITH {POINTS}, sp AS (SELECT cluster, sum(x * x) / count(DISTINCT vec_id) AS q FROM p GROUP BY 1), xx AS (SELECT vec_id, sum(x * x) AS xx FROM p GROUP BY 1),
    d AS (SELECT p.vec_id, p.cluster, c.cluster AS other, max(xx) - 2 * sum(x * c) + max(q) AS d FROM p JOIN c ON p.dim = c.dim JOIN sp ON sp.cluster = c.cluster JOIN xx ON xx.vec_id = p.vec_id GROUP BY ALL),
    ab AS (SELECT vec_id, d.cluster, max(CASE WHEN d.cluster = other THEN d * n / (n - 1) END) AS a, min(CASE WHEN d.cluster <> other THEN d END) AS b FROM d JOIN n ON n.cluster = other GROUP BY ALL)
    SELECT vec_id AS id, cluster, round((b - a) / greatest(a, b), 5) AS silhouette FROM ab""")
def silhouette(spark, sf_dir):
    return validation.silhouette(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding").withColumn("silhouette", F.round("silhouette", 5))


@query("scatter_indices", f"""WITH {POINTS}, per AS (SELECT p.dim, sum(x * x) AS q, sum(x) AS s, count(*) AS n FROM p GROUP BY 1), cc AS (SELECT dim, sum(n * c * c) AS c FROM c JOIN n USING (cluster) GROUP BY 1),
    t AS (SELECT sum(q - c) AS w, sum(c - s * s / n) AS b, max(n) AS n FROM per JOIN cc USING (dim)), k AS (SELECT count(*) AS k FROM n)
    SELECT n, k, round(w, 5) AS "within", round(b, 5) AS "between", round(b / (w + b), 6) AS explained, round(b / (k - 1) / (w / (n - k)), 5) AS calinski_harabasz FROM t, k""")
def scatter_indices(spark, sf_dir):
    s = validation.scatter(read(spark, sf_dir, "embeddings"), "label", "embedding")
    return s.select("n", "k", F.round("within", 5).alias("within"), F.round("between", 5).alias("between"), F.round("explained", 6).alias("explained"), F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


@query("davies_bouldin", f"""WITH {POINTS}, s AS (SELECT p.cluster, sqrt(sum((x - c) * (x - c)) / max(n)) AS s FROM p JOIN c ON p.cluster = c.cluster AND p.dim = c.dim JOIN n ON n.cluster = p.cluster GROUP BY 1),
    d AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY 1, 2)
    SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / d) AS w FROM d JOIN s x ON i = x.cluster JOIN s y ON j = y.cluster GROUP BY 1)""")
def davies_bouldin(spark, sf_dir):
    return validation.davies_bouldin(read(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("davies_bouldin", F.round("davies_bouldin", 6))


@query("davies_bouldin_mean", f"""WITH {POINTS}, s AS (SELECT cluster, avg(r) AS s FROM (SELECT p.cluster, vec_id, sqrt(sum((x - c) * (x - c))) AS r FROM p JOIN c ON p.cluster = c.cluster AND p.dim = c.dim GROUP BY ALL) GROUP BY 1),
    d AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY 1, 2)
    SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / d) AS w FROM d JOIN s x ON i = x.cluster JOIN s y ON j = y.cluster GROUP BY 1)""")
def davies_bouldin_mean(spark, sf_dir):
    return validation.davies_bouldin(read(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id").withColumn("davies_bouldin", F.round("davies_bouldin", 6))


@query("dunn_index", f"""WITH {POINTS}, r AS (SELECT 2 * max(r) AS diameter FROM (SELECT vec_id, sqrt(sum((x - c) * (x - c))) AS r FROM p JOIN c ON p.cluster = c.cluster AND p.dim = c.dim GROUP BY 1)),
    d AS (SELECT min(d) AS least FROM (SELECT sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.cluster < b.cluster GROUP BY a.cluster, b.cluster)) SELECT round(least / diameter, 6) AS dunn FROM r, d""")
def dunn_index(spark, sf_dir):
    return validation.dunn(read(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("dunn", F.round("dunn", 6))


FAR = "far AS (SELECT a.vec_id AS id, CAST(a.label AS VARCHAR) AS cluster, CAST(b.label AS VARCHAR) AS other, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


@query("silhouette_exact", f"""WITH {FAR}, m AS (SELECT id, cluster, other, avg(d) AS d FROM far GROUP BY ALL),
    ab AS (SELECT id, cluster, max(d) FILTER (cluster = other) AS a, min(d) FILTER (cluster <> other) AS b FROM m GROUP BY ALL)
    SELECT id, cluster, round((b - a) / greatest(a, b), 5) AS silhouette FROM ab WHERE a IS NOT NULL AND b IS NOT NULL""")
def silhouette_exact(spark, sf_dir):
    p = validation.distance_profiles(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return validation.silhouette_exact(p).withColumn("silhouette", F.round("silhouette", 5))


@query("dunn_exact", f"WITH {FAR} SELECT round(min(d) FILTER (cluster <> other) / max(d) FILTER (cluster = other), 6) AS dunn FROM far")
def dunn_exact(spark, sf_dir):
    p = validation.distance_profiles(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return validation.dunn_exact(p).withColumn("dunn", F.round("dunn", 6))


@query("ari_nmi", """
    WITH t AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS n FROM t GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM t GROUP BY 1), tot AS (SELECT sum(n) AS n FROM t),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS st, (SELECT sum(n * (n - 1) / 2) FROM ra) AS sa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS sb, (SELECT n * (n - 1) / 2 FROM tot) AS c,
        (SELECT sum(t.n / tot.n * ln(t.n * tot.n / (ra.n * rb.n))) FROM t JOIN ra USING (a) JOIN rb USING (b), tot) AS mi, (SELECT -sum(ra.n / tot.n * ln(ra.n / tot.n)) FROM ra, tot) AS ha, (SELECT -sum(rb.n / tot.n * ln(rb.n / tot.n)) FROM rb, tot) AS hb)
    SELECT round((st - sa * sb / c) / ((sa + sb) / 2 - sa * sb / c), 6) AS ari, round(mi / sqrt(ha * hb), 6) AS nmi FROM s""")
def ari_nmi(spark, sf_dir):
    return validation.agreement(read(spark, sf_dir, "labels"), "quality", "toxic").select(F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


PLACED = f"{PARTS}, pl AS (SELECT src, dst, weight, a.p_type AS cs, b.p_type AS cd FROM edges JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey)"


def _part_types(spark, sf_dir):
    return stage(part_sequence(spark, sf_dir), "parts"), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("cluster"))


@query("modularity", f"""WITH {PLACED}, m AS (SELECT sum(weight) AS m FROM pl), l AS (SELECT cs AS k, sum(weight) AS l FROM pl WHERE cs = cd GROUP BY 1), d AS (SELECT k, sum(weight) AS d FROM (SELECT cs AS k, weight FROM pl UNION ALL SELECT cd, weight FROM pl) GROUP BY 1)
    SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM d LEFT JOIN l USING (k), m""")
def modularity(spark, sf_dir):
    return validation.modularity(*_part_types(spark, sf_dir)).withColumn("modularity", F.round("modularity", 6))


@query("community_report", f"""WITH {PLACED}, e AS (SELECT cs AS cluster, weight, true AS i FROM pl WHERE cs = cd UNION ALL SELECT cs, weight, false FROM pl WHERE cs <> cd UNION ALL SELECT cd, weight, false FROM pl WHERE cs <> cd),
    g AS (SELECT cluster, count(*) FILTER (i) AS internal, count(*) FILTER (NOT i) AS external, CAST(coalesce(sum(weight) FILTER (i), 0) AS DOUBLE) AS internal_weight, CAST(coalesce(sum(weight) FILTER (NOT i), 0) AS DOUBLE) AS cut_weight FROM e GROUP BY 1),
    n AS (SELECT p_type AS cluster, count(*) AS n_nodes FROM part GROUP BY 1), t AS (SELECT 2 * sum(weight) AS t FROM pl)
    SELECT cluster, n_nodes, internal, external, internal_weight, cut_weight, round(cut_weight / least(2 * internal_weight + cut_weight, t - 2 * internal_weight - cut_weight), 6) AS conductance, round(internal / (n_nodes * (n_nodes - 1) / 2), 6) AS density FROM n JOIN g USING (cluster), t""")
def community_report(spark, sf_dir):
    return validation.community_report(*_part_types(spark, sf_dir)).withColumns({"conductance": F.round("conductance", 6), "density": F.round("density", 6)})


@query("graph_quality", f"""WITH {PLACED}, m AS (SELECT sum(weight) AS m FROM pl), l AS (SELECT cs AS k, sum(weight) AS l FROM pl WHERE cs = cd GROUP BY 1), d AS (SELECT k, sum(weight) AS d FROM (SELECT cs AS k, weight FROM pl UNION ALL SELECT cd, weight FROM pl) GROUP BY 1),
    mo AS (SELECT sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))) AS modularity, avg((d - 2 * coalesce(l, 0)) / least(d, 2 * m - d)) AS conductance FROM d LEFT JOIN l USING (k), m),
    co AS (SELECT sum(CASE WHEN cs = cd THEN weight ELSE 0 END) / sum(weight) AS coverage FROM pl),
    u AS (SELECT count(*) FILTER (a.p_type = b.p_type) AS iu, count(*) FILTER (a.p_type <> b.p_type) AS xu FROM und JOIN part a ON und.a = a.p_partkey JOIN part b ON und.b = b.p_partkey),
    s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS ip FROM (SELECT count(*) AS n FROM part GROUP BY p_type)),
    q AS (SELECT modularity, conductance, coverage, (iu + (n * (n - 1) / 2 - ip - xu)) / (n * (n - 1) / 2) AS performance FROM mo, co, u, s)
    SELECT round(modularity, 6) AS modularity, round(conductance, 6) AS conductance, round(coverage, 6) AS coverage, round(performance, 6) AS performance, round((0.3 * modularity + 0.2 * (1 - conductance) + 0.2 * coverage + 0.1 * performance) / 0.8, 6) AS score FROM q""")
def graph_quality(spark, sf_dir):
    q = validation.graph_quality(*_part_types(spark, sf_dir))
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query("simplified_validation", """
    WITH s AS (SELECT p_type AS c, count(*) AS n FROM part GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS k, max(n) AS most, min(n) AS least FROM s)
    SELECT n, k, most, least, round(1 - CASE WHEN most > n / 2 THEN 0.5 ELSE 0 END - CASE WHEN least < 2 THEN 0.2 ELSE 0 END - CASE WHEN k < 3 OR k > 2 * sqrt(n) THEN 0.3 ELSE 0 END, 6) AS score, 1 - CASE WHEN most > n / 2 THEN 0.5 ELSE 0 END - CASE WHEN least < 2 THEN 0.2 ELSE 0 END - CASE WHEN k < 3 OR k > 2 * sqrt(n) THEN 0.3 ELSE 0 END > 0.7001 AS optimal FROM t""")
def simplified_validation(spark, sf_dir):
    return validation.simplified(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("cluster"))).withColumn("score", F.round("score", 6))


@query("structural_constraints", f"WITH {PLACED} SELECT round((SELECT avg(CASE WHEN cs <> cd THEN 1.0 ELSE 0 END) FROM pl), 6) AS cross_share, 0.0 AS noise, 1.0 AS coverage, true AS valid")
def structural_constraints(spark, sf_dir):
    e, m = _part_types(spark, sf_dir)
    return validation.constraints(e, m, graph.nodes_of(e)).withColumn("cross_share", F.round("cross_share", 6))


def _dbscan_sql(name: str, least: float) -> str:
    """CTEs that end in ``name`` (node, cluster, role): DBSCAN over cosine similarities from ``least`` on, with 4 partners."""
    return f"""
    {name}_p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {least}),
    {name}_c AS (SELECT a AS node FROM {name}_p GROUP BY a HAVING count(*) >= 4),
    {name}_r AS (SELECT node, node AS cluster FROM {name}_c UNION SELECT b, cluster FROM {name}_r JOIN {name}_p ON node = a JOIN {name}_c c ON c.node = b),
    {name}_k AS (SELECT node, min(cluster) AS cluster FROM {name}_r GROUP BY node),
    {name}_b AS (SELECT b AS node, min(cluster) AS cluster FROM {name}_p JOIN {name}_k ON node = a WHERE b NOT IN (SELECT node FROM {name}_c) GROUP BY b),
    {name} AS (SELECT v.vec_id AS node, coalesce(k.cluster, b.cluster) AS cluster, CASE WHEN k.node IS NOT NULL THEN 'core' WHEN b.node IS NOT NULL THEN 'border' ELSE 'noise' END AS role
        FROM embeddings v LEFT JOIN {name}_k k ON v.vec_id = k.node LEFT JOIN {name}_b b ON v.vec_id = b.node)"""


def _three(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nodes = v.select(F.col("vec_id").alias("node"))
    p = stage(similarity.similar_pairs(v, "vec_id", "embedding", 0.4), "pairs")
    out = None
    for name, least in (("macro", 0.4), ("meso", 0.5), ("micro", 0.6)):
        part = clustering.dbscan(p.where(F.col("similarity") >= least), nodes, 4).select(F.lit(name).alias("algo"), "node", "cluster")
        out = part if out is None else out.unionByName(part)
    return stage(out, "three")


@query("dbscan_embeddings", f"WITH RECURSIVE {_dbscan_sql('meso', 0.5)} SELECT * FROM meso")
def dbscan_embeddings(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return clustering.dbscan(stage(similarity.similar_pairs(v, "vec_id", "embedding", 0.5), "pairs"), v.select(F.col("vec_id").alias("node")), 4)


@query("dbscan_consensus", f"""
    WITH RECURSIVE {_dbscan_sql('macro', 0.4)}, {_dbscan_sql('meso', 0.5)}, {_dbscan_sql('micro', 0.6)},
    p AS (SELECT node, 'macro=' || coalesce(CAST(a.cluster AS VARCHAR), '-') || '|meso=' || coalesce(CAST(b.cluster AS VARCHAR), '-') || '|micro=' || coalesce(CAST(c.cluster AS VARCHAR), '-') AS pattern FROM macro a JOIN meso b USING (node) JOIN micro c USING (node))
    SELECT pattern, count(*) AS n, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS nodes FROM p GROUP BY pattern HAVING count(*) >= 2""")
def dbscan_consensus(spark, sf_dir):
    return clustering.consensus(_three(spark, sf_dir)).select("pattern", "n", F.array_join("nodes", ",").alias("nodes"))


@query("clustering_stability")
def clustering_stability(spark, sf_dir):
    return validation.stability(_three(spark, sf_dir))


@query("kmeans_embeddings")
def kmeans_embeddings(spark, sf_dir):
    return clustering.k_means(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


@query("hierarchical_embeddings")
def hierarchical_embeddings(spark, sf_dir):
    return clustering.bisecting(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


@query("size_buckets", "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT CASE WHEN n <= 5 THEN 'small' WHEN n <= 15 THEN 'medium' WHEN n <= 30 THEN 'large' ELSE 'huge' END AS bucket, count(*) AS customers FROM n GROUP BY 1")
def size_buckets(spark, sf_dir):
    return clustering.size_buckets(read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))).groupBy("bucket").agg(F.count("*").alias("customers"))


@query("clustering_suitability", f"WITH {TRADE}, e AS (SELECT count(*) AS e, round(avg(weight), 6) AS mean, round(var_pop(weight), 6) AS variance FROM edges), n AS (SELECT count(*) AS n FROM nodes) SELECT n, e, mean, variance, e / n >= greatest(1, 0.5 * ln(n)) AND mean >= 0.3 AND variance >= 0.01 AS suitable FROM n, e")
def clustering_suitability(spark, sf_dir):
    return clustering.suitable(stage(trade_graph(spark, sf_dir), "trade")).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 6)})


from tablescape import catalog_queries  # noqa: E402, F401  registers its queries
