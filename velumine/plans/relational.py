"""Relational queries: projections, joins, aggregates, windows, ordering and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velumine.operators import relational as R
from velumine.plans.registry import query
from velumine.sources.tables import load


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [load(spark, sf_dir, n) for n in names]


# Projections, filters, predicates


@query("filter_project", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_discount < 0.03")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.filter("l_shipdate >= timestamp_ntz'1999-01-01' and l_discount < 0.03").select("l_orderkey", "l_linenumber", "l_quantity")


@query("json_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90")
def json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ev,) = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return ev.filter(k >= 90).select("event_id", k.alias("k"))


@query("json_group", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS bucket, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY ALL")
def json_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ev,) = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return ev.groupBy("event_type", (k % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))


@query("metadata_group", """SELECT json_extract_string(m, '$.category') AS category, count(*) AS n, round(avg(TRY_CAST(json_extract_string(m, '$.rating') AS DOUBLE)), 4) AS avg_rating
FROM (SELECT CASE WHEN json_valid(metadata) THEN metadata END AS m FROM documents) WHERE json_extract_string(m, '$.category') IS NOT NULL GROUP BY 1""")
def metadata_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = _t(spark, sf_dir, "documents")
    m = R.lenient_json("metadata")
    rows = d.select(F.try_variant_get(m, "$.category", "string").alias("category"), F.try_variant_get(m, "$.rating", "double").alias("rating"))
    return rows.filter("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 4).alias("avg_rating"))


@query("time_window_filter", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31'")
def time_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ev,) = _t(spark, sf_dir, "events")
    return R.in_window(ev, "ts", "2024-01-31", "week").select("event_id")


@query("tag_filter", "SELECT DISTINCT trim(id) AS id FROM memories WHERE list_has_any(tags, ['field', 'partition'])")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    (m,) = _t(spark, sf_dir, "memories")
    return m.filter(F.arrays_overlap("tags", F.array(F.lit("field"), F.lit("partition")))).select(F.trim("id").alias("id")).distinct()


@query("node_filter", "SELECT DISTINCT trim(id) AS id FROM nodes WHERE lower(trim(type)) = 'function' AND file_path LIKE 'lib/%' AND name IS NOT NULL")
def node_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    (n,) = _t(spark, sf_dir, "nodes")
    return n.filter(F.lower(F.trim("type")) == "function").filter(F.col("file_path").like("lib/%") & F.col("name").isNotNull()).select(F.trim("id").alias("id")).distinct()


# Joins


@query("join_inner", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join_chunks_documents", """SELECT c.id, d.doc_id, c.level, length(d.text) AS doc_chars FROM (SELECT DISTINCT trim(id) AS id, doc_id, lower(trim(level)) AS level FROM chunks) c
JOIN documents d ON 'doc' || d.doc_id = trim(c.doc_id) WHERE c.level = 'paragraph'""")
def join_chunks_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d = _t(spark, sf_dir, "chunks", "documents")
    c = c.select(F.trim("id").alias("id"), F.trim("doc_id").alias("_doc"), F.lower(F.trim("level")).alias("level")).filter("level = 'paragraph'").distinct()
    d = d.select("doc_id", F.length("text").cast("long").alias("doc_chars"), F.concat(F.lit("doc"), F.col("doc_id")).alias("_doc"))
    return c.join(d, "_doc").select("id", "doc_id", "level", "doc_chars")


@query("join_left", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("join_full", """SELECT coalesce(a.k, b.k) AS nation, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer", "supplier")
    a = c.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = s.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nation", "full")


@query("join_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    return o.join(li.filter("l_quantity > 48"), o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_totalprice > 300000"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("join_endpoints", """WITH e AS (SELECT DISTINCT trim(id) AS id, trim(source_id) AS s, trim(target_id) AS t, lower(trim(type)) AS type FROM edges), n AS (SELECT DISTINCT trim(id) AS id, trim(file_path) AS f FROM nodes)
SELECT a.f AS source_file, b.f AS target_file, e.type, count(DISTINCT e.id) AS n FROM e JOIN n a ON a.id = e.s JOIN n b ON b.id = e.t WHERE a.f <> b.f GROUP BY 1, 2, 3 HAVING count(DISTINCT e.id) >= 2""")
def join_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _t(spark, sf_dir, "edges", "nodes")
    e = e.select(F.trim("id").alias("id"), F.trim("source_id").alias("s"), F.trim("target_id").alias("t"), F.lower(F.trim("type")).alias("type")).distinct()
    n = n.select(F.trim("id").alias("k"), F.trim("file_path").alias("f")).distinct()
    a, b = n.select(F.col("k").alias("s"), F.col("f").alias("source_file")), n.select(F.col("k").alias("t"), F.col("f").alias("target_file"))
    both = e.join(a, "s").join(b, "t").filter("source_file <> target_file")
    return both.groupBy("source_file", "target_file", "type").agg(F.count_distinct("id").alias("n")).filter("n >= 2")


@query("join_range", "SELECT a.event_id AS purchase, count(*) AS views FROM events a JOIN events b ON b.user_id = a.user_id AND b.event_type = 'view' AND b.ts >= a.ts - INTERVAL 1 DAY AND b.ts < a.ts WHERE a.event_type = 'purchase' GROUP BY 1")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ev,) = _t(spark, sf_dir, "events")
    a = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "ts")
    b = ev.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"))
    return R.range_join(a, b, "user_id", "ts", "seen", before_seconds=86_400).groupBy("purchase").agg(F.count(F.lit(1)).alias("views"))


@query("join_asof", "SELECT a.event_id, b.event_id AS prior_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ev,) = _t(spark, sf_dir, "events")
    a = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = ev.filter("event_type = 'view'").select(F.col("event_id").alias("prior_view"), "user_id", "ts")
    return R.asof_join(a, b, "user_id", "ts", ["prior_view"]).select("event_id", "prior_view")


@query("join_enclosing", """WITH e AS (SELECT DISTINCT trim(id) AS edge_id, trim(source_id) AS s, CAST(json_extract_string(CASE WHEN json_valid(properties) THEN properties END, '$.line') AS INT) AS line FROM edges),
f AS (SELECT trim(id) AS s, min(file_path) AS file_path FROM nodes GROUP BY 1),
n AS (SELECT trim(id) AS id, min(file_path) AS file_path, min(start_line) AS a, max(coalesce(end_line, start_line)) AS b FROM nodes WHERE lower(trim(type)) IN ('function', 'method') GROUP BY 1)
SELECT edge_id, min_by(n.id, row(n.b - n.a, n.id)) AS enclosing FROM e JOIN f USING (s) JOIN n ON n.file_path = f.file_path AND line BETWEEN n.a AND n.b GROUP BY 1""")
def join_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tightest function around each reference's line, by bins of lines in a file."""
    e, n = _t(spark, sf_dir, "edges", "nodes")
    line = F.get_json_object("properties", "$.line").try_cast("int")
    e = e.select(F.trim("id").alias("edge_id"), F.trim("source_id").alias("s"), line.alias("line")).filter("line is not null").distinct()
    files = n.groupBy(F.trim("id").alias("s")).agg(F.min("file_path").alias("file_path"))
    symbols = n.filter(F.lower(F.trim("type")).isin("function", "method")).groupBy(F.trim("id").alias("id")).agg(F.min("file_path").alias("file_path"), F.min("start_line").alias("a"), F.max(F.coalesce("end_line", "start_line")).alias("b"))
    return R.enclosing(e.join(files, "s"), symbols, "file_path", "line", "a", "b", "id", "edge_id")


@query("join_sql", "SELECT n_name, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def join_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free SQL over views of the tables."""
    return R.sql(spark, sf_dir, "SELECT n_name, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")


# Aggregates


@query("agg_basic", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax,
round(stddev_samp(l_quantity), 4) AS sd_qty, round(var_samp(l_quantity), 4) AS var_qty FROM lineitem GROUP BY 1, 2""")
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_discount").alias("min_disc"),
        F.max("l_tax").alias("max_tax"), F.round(F.stddev_samp("l_quantity"), 4).alias("sd_qty"), F.round(F.var_samp("l_quantity"), 4).alias("var_qty"),
    )


@query("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    return o.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("agg_having", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 500")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts")).filter("parts >= 500")


@query("agg_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"), F.count(F.lit(1)).alias("n"))


@query("agg_rollup", "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = _t(spark, sf_dir, "region", "nation", "customer")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))  # tables of fixed size


@query("agg_conditional", "SELECT type, count(*) AS n, count(*) FILTER (forgotten = 1) AS forgotten, round(avg(importance), 3) AS avg_importance FROM (SELECT DISTINCT trim(id) AS id, lower(trim(type)) AS type, forgotten, importance FROM memories) GROUP BY 1")
def agg_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    (m,) = _t(spark, sf_dir, "memories")
    m = m.select(F.trim("id").alias("id"), F.lower(F.trim("type")).alias("type"), "forgotten", "importance").distinct()
    return m.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("forgotten") == 1).alias("forgotten"), F.round(F.avg("importance"), 3).alias("avg_importance"))


@query("agg_percentile", """WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, v[(round(0.5 * (length(v) - 1)) + 1)::INT] AS p50, v[(round(0.95 * (length(v) - 1)) + 1)::INT] AS p95, v[(round(0.99 * (length(v) - 1)) + 1)::INT] AS p99 FROM s""")
def agg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest ranks by counting distinct values, so that no group is collected."""
    (ev,) = _t(spark, sf_dir, "events")
    return R.nearest_rank(ev, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("agg_latest", "SELECT o_custkey, max_by(o_orderkey, row(o_orderdate, o_orderkey)) AS latest, count(*) AS n FROM orders GROUP BY 1")
def agg_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count(F.lit(1)).alias("n"))


@query("agg_udaf", "SELECT event_type, round(exp(avg(ln(value))), 6) AS geometric_mean FROM events WHERE value > 0 GROUP BY 1")
def agg_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom aggregate from partial sums, without a Python function."""
    (ev,) = _t(spark, sf_dir, "events")
    return ev.filter("value > 0").groupBy("event_type").agg(F.round(R.geometric_mean("value"), 6).alias("geometric_mean"))


@query("agg_approx")
def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median_qty"))


@query("tenant_usage", "SELECT source AS tenant, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def tenant_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = _t(spark, sf_dir, "documents")
    return d.filter("text is not null and source is not null").groupBy(F.col("source").alias("tenant")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


# Windows


@query("win_rank", """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS quarter FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    w, v = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return o.select("o_orderkey", *[f.cast("long").alias(n) for n, f in (("rn", F.row_number().over(w)), ("rk", F.rank().over(v)), ("dr", F.dense_rank().over(v)), ("quarter", F.ntile(4).over(w)))])


@query("win_frame", """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS moving,
round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events""")
def win_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ev,) = _t(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select("event_id", F.round(F.sum("value").over(w.rowsBetween(-4, 0)), 4).alias("moving"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@query("win_lag", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_type) OVER w AS next_type, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ev,) = _t(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_type").over(w).alias("next_type"), F.first("event_id").over(w).alias("first_id"))


@query("win_dist", "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)")
def win_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_orderstatus").orderBy("o_totalprice")
    return o.select("o_orderkey", F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("dedupe_first", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ev,) = _t(spark, sf_dir, "events")
    return R.first_per_key(ev, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


# Ordering and limits


@query("topk_global", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("topk_per_group", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    return R.top_per_key(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, salt="o_orderkey").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("page_offset", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = _t(spark, sf_dir, "part")
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20).select("p_partkey", "p_retailprice")


@query("case_order", "SELECT id, confidence FROM (SELECT DISTINCT trim(id) AS id, confidence FROM edges) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, id LIMIT 40")
def case_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = _t(spark, sf_dir, "edges")
    order = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    return e.select(F.trim("id").alias("id"), "confidence").distinct().orderBy(order, "id").limit(40)


@query("least_full", "SELECT source, n FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) ORDER BY n, source LIMIT 1")
def least_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = _t(spark, sf_dir, "documents")
    return d.filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "source").limit(1)


# Set operations


@query("set_union", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer", "supplier")
    return c.filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey"))


@query("set_intersect", "SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = _t(spark, sf_dir, "lineitem", "supplier")
    return li.filter("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("k")).intersect(s.filter("s_acctbal > 0").select("s_suppkey"))


@query("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = _t(spark, sf_dir, "part", "lineitem")
    return p.select(F.col("p_partkey").alias("k")).subtract(li.filter("l_quantity > 45").select("l_partkey"))


@query("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).exceptAll(s.select("s_nationkey"))


@query("anti_merge", """WITH v AS (SELECT doc_id FROM documents WHERE lower(text) LIKE '%crater%'), k AS (SELECT doc_id FROM documents WHERE lower(text) LIKE '%tensor%')
SELECT doc_id, 0 AS source_rank FROM v UNION ALL SELECT doc_id, 1 FROM k WHERE doc_id NOT IN (SELECT doc_id FROM v)""")
def anti_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = _t(spark, sf_dir, "documents")
    v, k = (d.filter(F.lower("text").contains(w)).select("doc_id") for w in ("crater", "tensor"))
    return R.merge_hits(v, k, "doc_id")


# Scalar functions


@query("scalar_paths", """SELECT DISTINCT file_path, CASE WHEN instr(file_path, '/') > 1 THEN left(file_path, instr(file_path, '/') - 1) ELSE '' END AS segment,
coalesce(list_filter(string_split(file_path, '/'), lambda x: x <> '')[1], '_root') AS package, sha256(file_path) AS digest FROM nodes WHERE file_path IS NOT NULL""")
def scalar_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    (n,) = _t(spark, sf_dir, "nodes")
    return n.filter("file_path is not null").select("file_path").distinct().select("file_path", R.first_segment("file_path").alias("segment"), R.package("file_path").alias("package"), F.sha2("file_path", 256).alias("digest"))


@query("scalar_language", """SELECT e AS extension, count(*) AS n, any_value(CASE e WHEN 'ex' THEN 'elixir' WHEN 'exs' THEN 'elixir' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' ELSE 'unknown' END) AS language
FROM (SELECT lower(regexp_extract(trim(file_path), '\\.([A-Za-z]+)$', 1)) AS e FROM nodes WHERE file_path IS NOT NULL) GROUP BY 1""")
def scalar_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    (n,) = _t(spark, sf_dir, "nodes")
    e = F.lower(F.regexp_extract(F.trim("file_path"), r"\.([A-Za-z]+)$", 1))
    return n.filter("file_path is not null").groupBy(e.alias("extension")).agg(F.count(F.lit(1)).alias("n"), F.first(R.language_of("file_path")).alias("language"))


@query("scalar_tokens", "SELECT doc_id, length(text) // 4 AS tokens, left(trim(regexp_replace(lower(left(text, 60)), '[^a-z0-9]+', '_', 'g'), '_'), 40) AS slug FROM documents WHERE text IS NOT NULL")
def scalar_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = _t(spark, sf_dir, "documents")
    return d.filter("text is not null").select("doc_id", R.token_estimate("text").alias("tokens"), R.slug(F.left("text", F.lit(60))).alias("slug"))


@query("scalar_dates", """SELECT o_orderkey, date_sub('day', o_orderdate, TIMESTAMP '2001-01-01') AS age_days, strftime(o_orderdate, '%Y-%m') AS month, o_orderdate + INTERVAL 90 SECOND AS later FROM orders""")
def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.expr("timestampdiff(DAY, o_orderdate, timestamp_ntz'2001-01-01')").alias("age_days"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_orderdate") + F.expr("INTERVAL 90 SECONDS")).alias("later"))


@query("scalar_template", "SELECT s_suppkey, 'Supplier ' || s_name || ' of ' || s_nationkey || ' {{unknown}}' AS text FROM supplier")
def scalar_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = _t(spark, sf_dir, "supplier")
    return s.select("s_suppkey", R.interpolate("Supplier {{name}} of {{ nation }} {{unknown}}", {"name": F.col("s_name"), "nation": F.col("s_nationkey")}).alias("text"))
