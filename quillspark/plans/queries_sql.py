"""Queries given as SQL text, which Spark and the oracle run alike, and a few built with the API."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.session import table

_TEXT = {
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_shipping_priority": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate""",
    "sql_local_suppliers": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name""",
    "sql_forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "sql_large_orders": """SELECT c_name, o_orderkey, o_totalprice, sum(l_quantity) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, o_orderkey, o_totalprice""",
    "sql_exists_late": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) GROUP BY o_orderpriority",
    "sql_customers_without_orders": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_grouping_sets": "SELECT collection, publicationdate.year AS year, count(*) AS n, grouping(collection) AS g FROM paper GROUP BY GROUPING SETS ((collection, publicationdate.year), (collection), ())",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT lang, source, count(*) AS n, count(DISTINCT venue_id) AS venues FROM documents GROUP BY CUBE (lang, source)",
    "sql_windows": """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr,
        lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after,
        round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders""",
    "sql_ntile": "SELECT p_partkey, ntile(10) OVER (ORDER BY p_retailprice, p_partkey) AS decile FROM part",
    "sql_union_all": "SELECT title FROM paper UNION ALL SELECT title FROM meta_record",
    "sql_union": "SELECT title FROM paper UNION SELECT title FROM meta_record",
    "sql_intersect": "SELECT title FROM paper INTERSECT SELECT title FROM meta_record",
    "sql_except": "SELECT title FROM meta_record EXCEPT SELECT title FROM paper",
    "sql_full_outer": "SELECT coalesce(a.venue_id, b.venue_id) AS venue_id, a.n AS papers, b.n AS n_documents FROM (SELECT venue_id, count(*) AS n FROM paper GROUP BY venue_id) a FULL OUTER JOIN (SELECT venue_id, count(*) AS n FROM documents GROUP BY venue_id) b ON a.venue_id = b.venue_id",
    "sql_cte_scalar": "WITH m AS (SELECT max(n_chars) AS longest FROM documents) SELECT doc_id, n_chars FROM documents, m WHERE n_chars * 2 > longest",
    "sql_venues_without_papers": "SELECT venue_id, name FROM venue_list v WHERE NOT EXISTS (SELECT 1 FROM paper p WHERE p.venue_id = v.venue_id AND p.collection = 'arXiv')",
    "sql_case_filter": "SELECT collection, sum(CASE WHEN isduplicated THEN 1 ELSE 0 END) AS marked, count(*) FILTER (WHERE abstract IS NULL) AS without_abstract FROM paper GROUP BY collection",
    "sql_correlated_max": "SELECT id_int, last_update_unixtime FROM paper_store s WHERE last_update_unixtime = (SELECT max(last_update_unixtime) FROM paper_store t WHERE t.collection = s.collection AND t.id_int = s.id_int)",
    "sql_range_join": "SELECT a.s_suppkey, count(*) AS customers FROM supplier a JOIN customer b ON b.c_nationkey = a.s_nationkey AND b.c_acctbal BETWEEN a.s_acctbal - 100 AND a.s_acctbal + 100 GROUP BY a.s_suppkey",
    "sql_quantiles": "SELECT event_type, round(stddev_pop(value), 6) AS sd, round(var_samp(value), 6) AS vs, round(corr(value, user_id), 6) AS r, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings paper paragraph paper_store meta_record author_name removal_log venue_list subject_area subject_label mix_target".split()


def _sql(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in _TABLES if re.search(rf"\b{t}\b", text)]
        return spark.sql(re.sub(r"\b(" + "|".join(used) + r")\b(?!\.)", lambda m: "{" + m.group(1) + "}", text), **{t: table(spark, sf_dir, t) for t in used})

    return query


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of a day."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days, one a day."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w"))
    return rows.agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("first_day"), "n")


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that end after six hours without an event."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(by).cast("timestamp").cast("double")
    marked = table(spark, sf_dir, "events").withColumn("new", F.when(gap <= 6 * 3600, 0).otherwise(1))
    numbered = marked.withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def events_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the value of the user's last event before it that is of type view, by one window over a union-free scan."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("value")), True).over(by)
    return table(spark, sf_dir, "events").select("event_id", seen.alias("last_view"))


def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("orders"))


def approximate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose approximate counts and medians are within a tenth of the exact ones."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    exact = rows.agg(F.countDistinct("l_partkey").alias("p"), F.countDistinct("l_orderkey").alias("o"), F.median("l_quantity").alias("m"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.1 * F.col(b)
    joined = approximate_counts(spark, sf_dir).join(exact, "l_returnflag")
    return joined.select("l_returnflag", (near("parts", "p") & near("orders", "o") & near("median", "m")).alias("near"))


def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return rows.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in ("F", "O", "P")])


QUERIES = {**{name: _sql(text) for name, text in _TEXT.items()}, **{f.__name__: f for f in (events_daily, events_sliding, events_sessions, events_as_of, approximate_counts, approximate_bounds, pivot_status)}}
SQL = {
    **_TEXT,
    "events_daily": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT strftime(d, '%Y-%m-%d') AS first_day, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1",
    "events_sessions": "SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2",
    "events_as_of": "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events",
    "approximate_bounds": "SELECT DISTINCT l_returnflag, true AS near FROM lineitem",
    "pivot_status": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
}
