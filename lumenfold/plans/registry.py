"""All registered queries of the engine, over stand-in tables, with their SQL counterparts.

Each entry pairs a function (spark, folder) -> DataFrame with SQL for the same rows, kept side by side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import exprs, images
from lumenfold.operators import culling, filters, grouping, learning, persons, quality, scoring, similarity, stats, text_index, windows
from lumenfold.plans import photos
from lumenfold.plans.catalog import ORACLES, QUERIES, query
from lumenfold.sources import tables

__all__ = ["ORACLES", "QUERIES", "photos"]

def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return tables.table(s, d, name)


def _parts(s: SparkSession, d: str) -> DataFrame:
    """Parts with a hue and a score from 0 to 10, as stand-ins for colour and quality."""
    return _t(s, d, "part").withColumn("hue", ((F.col("p_partkey") * 37) % 360).cast("double")).withColumn("score", F.round((F.col("p_retailprice") % 100) / 10, 3))


_PARTS = "(SELECT *, CAST((p_partkey * 37) % 360 AS DOUBLE) AS hue, ROUND((p_retailprice % 100) / 10, 3) AS score FROM part)"


def _customers(s: SparkSession, d: str) -> DataFrame:
    """Customers with coordinates derived from their keys."""
    return _t(s, d, "customer").withColumn("lat", ((F.col("c_custkey") * 7919) % 17000) / 100.0 - 85).withColumn("lon", ((F.col("c_custkey") * 104729) % 36000) / 100.0 - 180)


_CUSTOMERS = "(SELECT *, ((c_custkey * 7919) % 17000) / 100.0 - 85 AS lat, ((c_custkey * 104729) % 36000) / 100.0 - 180 AS lon FROM customer)"


# ------------------------------------------------------------------------------------------ statistics


@query("""WITH m AS (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rn FROM events GROUP BY 1, 2)
SELECT e.event_type, count(*) AS n, round(avg(e.value), 4) AS avg_value, max(m.user_id) AS top_user_id, max(m.n) AS top_n, round(count(*) / (SELECT count(*) FROM events), 6) AS share
FROM events e LEFT JOIN m ON m.event_type = e.event_type AND m.rn = 1 GROUP BY e.event_type""")
def category_stats_with_mode(s, d):
    return stats.group_stats_with_mode(_t(s, d, "events"), "event_type", ["value"], "user_id")


@query("SELECT count(*) AS n, round(avg(value), 4) AS avg_value, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM events")
def overview_stats(s, d):
    return stats.overview(_t(s, d, "events"), ["value"], "ts")


@query(f"SELECT round(score * 2) / 2 AS bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM {_PARTS}), 6) AS share FROM {_PARTS} GROUP BY 1")
def score_histogram(s, d):
    return stats.score_histogram(_parts(s, d), "score")


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS avg_score FROM part GROUP BY 1 HAVING count(*) >= 10 ORDER BY 3 DESC, 1 LIMIT 20")
def top_gear(s, d):
    return stats.top_groups(_t(s, d, "part"), "p_brand", "p_retailprice", 10, 20)


@query("SELECT p_brand, p_type, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def gear_combo_history(s, d):
    rows = _t(s, d, "lineitem").join(_t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(_t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("p_brand", "p_type", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_quantity < 10 THEN '<10' WHEN l_quantity < 25 THEN '10-24' WHEN l_quantity < 40 THEN '25-39' ELSE '40+' END AS bucket, count(*) AS n, min(l_quantity) AS least FROM lineitem GROUP BY 1")
def settings_buckets(s, d):
    return stats.histogram_of(_t(s, d, "lineitem"), "l_quantity", [10, 25, 40], ["<10", "10-24", "25-39", "40+"])


@query("SELECT CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def timeline_heatmap(s, d):
    return stats.heatmap(_t(s, d, "events"), "ts")


@query("SELECT strftime(ts, '%Y-%m') AS period, count(*) AS n, round(avg(value), 4) AS avg_score FROM events GROUP BY 1")
def monthly_timeline(s, d):
    return stats.by_period(_t(s, d, "events"), "ts", "yyyy-MM", "value")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_days(s, d):
    return _t(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "day").limit(10)


@query("SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS x, count(*) AS n, round(avg(l_extendedprice), 2) AS avg_l_extendedprice, round(avg(l_discount), 4) AS avg_l_discount FROM lineitem GROUP BY 1 HAVING count(*) >= 20")
def correlation_explorer(s, d):
    return stats.correlation_explorer(_t(s, d, "lineitem"), F.floor(F.col("l_quantity") / 5), ["l_extendedprice", "l_discount"], 20).withColumn("avg_l_extendedprice", F.round("avg_l_extendedprice", 2))


@query("""SELECT p_brand, 'p_size' AS metric, count(*) AS n, round(coalesce(corr(p_size, p_retailprice), 0), 4) AS r FROM part GROUP BY 1 HAVING count(*) >= 10
UNION ALL SELECT p_brand, 'p_partkey', count(*), round(coalesce(corr(p_partkey, p_retailprice), 0), 4) FROM part GROUP BY 1 HAVING count(*) >= 10""")
def pearson_by_category(s, d):
    return stats.pearson(_t(s, d, "part"), "p_brand", "p_retailprice", ["p_size", "p_partkey"])


@query("""WITH m AS (SELECT event_id, unnest(list_filter([CASE WHEN value >= 100 THEN 'high' END, CASE WHEN event_type = 'click' THEN 'click' END, CASE WHEN user_id < 50 THEN 'low_user' END, CASE WHEN hour(ts) < 6 THEN 'night' END], lambda x: x IS NOT NULL)) AS r FROM events)
SELECT a.r AS rule_a, b.r AS rule_b, count(*) AS n FROM m a JOIN m b ON a.event_id = b.event_id AND a.r < b.r GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50""")
def category_overlap(s, d):
    return stats.rule_overlap(_t(s, d, "events"), {"high": F.col("value") >= 100, "click": F.col("event_type") == "click", "low_user": F.col("user_id") < 50, "night": F.hour("ts") < 6})


@query("SELECT 'p_brand' AS dimension, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2")
def value_counts(s, d):
    return stats.value_counts(_t(s, d, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT tag, count(*) AS n FROM (SELECT DISTINCT p_partkey, trim(unnest(string_split(p_name, ' '))) AS tag FROM part) WHERE tag <> '' GROUP BY 1")
def tag_split_counts(s, d):
    return tables.tag_rows(_t(s, d, "part").withColumn("csv", F.replace("p_name", F.lit(" "), F.lit(","))), "p_partkey", "csv").groupBy("tag").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT 'p_size' AS metric, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part), e AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM m GROUP BY 1)
SELECT metric, lo, hi, CAST(CASE WHEN hi > lo THEN greatest(0, least(19, floor((v - lo) * 20 / (hi - lo)))) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM m JOIN e USING (metric) GROUP BY ALL""")
def metric_ranges(s, d):
    return stats.metric_ranges(_t(s, d, "part"), ["p_size", "p_retailprice"])


@query("SELECT count_if(value < 10) AS low, count_if(event_type = 'error') AS errors, count_if(hour(ts) < 6) AS night FROM events")
def hidden_summary(s, d):
    return stats.conditional_counts(_t(s, d, "events"), {"low": F.col("value") < 10, "errors": F.col("event_type") == "error", "night": F.hour("ts") < 6})


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events")
def type_counts(s, d):
    e = _t(s, d, "events")
    one = stats.conditional_counts(e, {"click": F.col("event_type") == "click", "view": F.col("event_type") == "view", "all": F.lit(True)})
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("event_type"), F.col(c).alias("n")) for c in ("click", "view", "all")))).alias("x")).select("x.*")


@query("SELECT l_returnflag, count(l_quantity) AS n, round(quantile_cont(l_quantity, .25), 4) AS p25, round(quantile_cont(l_quantity, .5), 4) AS median, round(quantile_cont(l_quantity, .75), 4) AS p75, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def percentiles_by_category(s, d):
    return stats.percentiles(_t(s, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN rn = least(floor(n * 50 / 100), n - 1) + 1 THEN value END) AS p50, max(CASE WHEN rn = least(floor(n * 95 / 100), n - 1) + 1 THEN value END) AS p95 FROM r GROUP BY 1""")
def nearest_rank_percentile(s, d):
    return stats.nearest_rank(_t(s, d, "events"), ["event_type"], "value", [50, 95], 50)


@query("SELECT count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS least, max(value) AS most, round(quantile_cont(value, .95), 4) AS p95 FROM events")
def numeric_summary(s, d):
    return stats.numeric_summary(_t(s, d, "events"), "value")


@query("""WITH q AS (SELECT year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(q AS INTEGER) AS q, n, round(a, 6) AS avg_score, coalesce(a >= lag(a) OVER (ORDER BY q) * 1.05, false) AS improved FROM q""")
def quarter_trend(s, d):
    return stats.quarter_trend(_t(s, d, "orders"), "o_orderdate", "o_totalprice")


@query("SELECT split_part(substr(url, 9), '/', 1) AS folder, count(*) AS n, arg_min(url, (-page_id, url)) AS best FROM pages WHERE starts_with(url, 'https://') GROUP BY 1")
def folder_rollup(s, d):
    return stats.folder_rollup(_t(s, d, "pages"), "url", "https://", "page_id")


# ------------------------------------------------------------------------------------------ filters and pages


@query(f"SELECT p_partkey, p_brand, score FROM {_PARTS} WHERE score >= 2.5 AND score <= 9 AND p_size <= 40 AND p_type = 'ECONOMY'")
def range_filters(s, d):
    q = filters.Query({"min_score": "2.5", "max_score": 9, "max_p_size": 40, "min_p_size": "junk", "p_type": "ECONOMY", "unknown": 1}, numeric=("score", "p_size"), equal=("p_type", "p_brand"))
    return q.apply(_parts(s, d)).select("p_partkey", "p_brand", "score")


_HUES = "CASE WHEN hue >= 345 OR hue < 15 THEN 'red' WHEN hue < 45 THEN 'orange' WHEN hue < 70 THEN 'yellow' WHEN hue < 165 THEN 'green' WHEN hue < 195 THEN 'cyan' WHEN hue < 255 THEN 'blue' WHEN hue < 300 THEN 'purple' ELSE 'magenta' END"


@query(f"SELECT {_HUES} AS bucket, count(*) AS n FROM {_PARTS} GROUP BY 1")
def hue_buckets(s, d):
    return _parts(s, d).groupBy(exprs.hue_bucket("hue").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN score >= 8 THEN 'excellent' WHEN score >= 7 THEN 'good' WHEN score >= 6 THEN 'fair' ELSE 'poor' END AS tier, count(*) AS n FROM {_PARTS} GROUP BY 1")
def quality_tiers(s, d):
    return _parts(s, d).groupBy(exprs.quality_tier("score").alias("tier")).agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, round(CASE WHEN p_size / 50.0 >= .2 THEN score * .2 + (p_size / 5.0) * .32 + (hue / 36) * .24 + score * .24 ELSE score * .2 + (p_size / 5.0) * .44 + (hue / 36) * .36 END, 4) AS top_score FROM {_PARTS} WHERE round(CASE WHEN p_size / 50.0 >= .2 THEN score * .2 + (p_size / 5.0) * .32 + (hue / 36) * .24 + score * .24 ELSE score * .2 + (p_size / 5.0) * .44 + (hue / 36) * .36 END, 4) >= 7")
def top_picks(s, d):
    p = _parts(s, d)
    return p.select("p_partkey", F.round(exprs.top_pick_score("score", F.col("p_size") / 5.0, F.col("hue") / 36, "score", F.col("p_size") / 50.0), 4).alias("top_score")).where("top_score >= 7")


@query("SELECT event_id, ts, value FROM events WHERE value >= 5 AND CAST(ts AS DATE) >= DATE '2024-01-03' AND CAST(ts AS DATE) <= DATE '2024-01-20' AND event_type = 'view' ORDER BY value DESC, event_id LIMIT 50 OFFSET 20")
def gallery_page(s, d):
    q = filters.Query({"min_value": 5, "date_from": "2024-01-03", "date_to": "2024-01-20", "event_type": "view"}, numeric=("value",), equal=("event_type",), date="ts")
    return windows.page(q.apply(_t(s, d, "events")).select("event_id", "ts", "value"), [F.col("value").desc_nulls_last(), F.col("event_id")], 20, 50)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15' GROUP BY 1 ORDER BY 1 DESC LIMIT 6")
def keyset_page(s, d):
    days = _t(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return windows.keyset_page(days, "day", "2024-01-15", 5).select("day", "n")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT (SELECT CAST(least(count(*) - ceil(count(*) * 98 / 100.0), 5000) AS BIGINT) FROM orders)")
def bottom_percent(s, d):
    return windows.worst_percent(_t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 98)


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM r WHERE o_totalprice >= (SELECT o_totalprice FROM r WHERE rn = greatest(1, CAST(floor(n * 0.01 + 0.5) AS BIGINT)) + 1) ORDER BY 2 DESC, 1 LIMIT 50""")
def golden_top1pct(s, d):
    return windows.top_percent(_t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def require_exclude_tags(s, d):
    l = _t(s, d, "labels")
    tags = l.where("quality = 1").select("doc_id", F.lit("good").alias("tag")).union(l.where("toxic = 1").select("doc_id", F.lit("toxic").alias("tag")))
    return filters.with_tags(_t(s, d, "documents").select("doc_id", "lang"), tags, "doc_id", ["good"], ["toxic"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def override_semi_anti(s, d):
    return tables.new_files(_t(s, d, "documents").select(F.col("doc_id").alias("path"), "source"), _t(s, d, "labels").select(F.col("doc_id").alias("path"))).withColumnRenamed("path", "doc_id")


@query("SELECT c_custkey, coalesce(n, 0) AS stars FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def prefs_overlay_left_join(s, d):
    own = _t(s, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("stars"))
    return filters.preferences_overlay(_t(s, d, "customer").select("c_custkey", F.lit(0).cast("long").alias("stars")), own, "c_custkey", ["stars"])


@query("SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (3, 7) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2")
def all_people_filter(s, d):
    faces = _t(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("person_id"))
    return filters.with_all_people(faces.select("l_orderkey").distinct(), faces, "l_orderkey", [3, 7])


@query("SELECT url, page_id FROM pages WHERE starts_with(url, 'https://m.') OR starts_with(url, 'http://th')")
def visibility_prefixes(s, d):
    return _t(s, d, "pages").where(filters.visible(F.col("url"), ["https://m.", "http://th"])).select("url", "page_id")


# ------------------------------------------------------------------------------------------ joins, windows, sets


@query("WITH f AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 8")
def copresence_pairs(s, d):
    return culling.copresence(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey", 8)


@query("WITH f AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 12")
def rare_pairs(s, d):
    return culling.copresence(_t(s, d, "lineitem"), "l_orderkey", "l_suppkey", 3, 12)


_TOPK = "SELECT day, event_id, rank, group_size FROM (SELECT CAST(ts AS DATE) AS day, event_id, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS group_size FROM events) WHERE rank <= "


@query(_TOPK + "3")
def timeline_topk(s, d):
    return windows.group_top_k(_t(s, d, "events").withColumn("day", F.to_date("ts")), ["day"], [F.col("value").desc(), F.col("event_id")], 3).select("day", "event_id", "rank", "group_size")


@query(_TOPK + "1")
def calendar_heroes(s, d):
    return windows.group_top_k(_t(s, d, "events").withColumn("day", F.to_date("ts")), ["day"], [F.col("value").desc(), F.col("event_id")], 1).select("day", "event_id", "rank", "group_size")


@query("""SELECT year, o_orderkey, total, rank FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey, count(*) OVER (PARTITION BY year(o_orderdate)) AS total, CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
FROM orders WHERE abs(date_diff('day', CAST(o_orderdate AS DATE), make_date(year(o_orderdate), 6, 15))) <= 3 AND year(o_orderdate) < 1998) WHERE rank <= 5""")
def on_this_day(s, d):
    return windows.on_this_day(_t(s, d, "orders"), "o_orderdate", 6, 15, 1998, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5, 3).select("year", "o_orderkey", "total", "rank")


@query("""WITH x AS (SELECT 'hour' AS dimension, CAST(hour(ts) AS VARCHAR) AS value, event_id, value AS score FROM events UNION ALL SELECT 'type', event_type, event_id, value FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY dimension, value ORDER BY score DESC, event_id) AS rank, count(*) OVER (PARTITION BY dimension, value) AS group_size FROM x)
SELECT dimension, value, event_id, CAST(rank AS INTEGER) AS rank, group_size FROM g WHERE rank <= 4 AND group_size >= 10""")
def dimension_capsules(s, d):
    return culling.dimension_collections(_t(s, d, "events"), {"hour": F.hour("ts"), "type": F.col("event_type")}, "value", "event_id", 4, 10)


@query("SELECT value, event_id, rank, group_size FROM (SELECT event_type || '/' || CAST(hour(ts) AS VARCHAR) AS value, event_id, CAST(row_number() OVER (PARTITION BY event_type, hour(ts) ORDER BY value DESC, event_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY event_type, hour(ts)) AS group_size FROM events) WHERE rank <= 2 AND group_size >= 5")
def cross_dimension_capsules(s, d):
    rows = _t(s, d, "events").withColumn("cross", F.concat("event_type", F.lit("/"), F.hour("ts").cast("string")))
    return windows.group_top_k(rows, ["cross"], [F.col("value").desc(), F.col("event_id")], 2, 5).select(F.col("cross").alias("value"), "event_id", "rank", "group_size")


@query("SELECT event_type, event_id, round(value, 2) AS best FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def score_per_dimension(s, d):
    return windows.group_top_k(_t(s, d, "events"), ["event_type"], [F.col("value").desc(), F.col("event_id")], 1).select("event_type", "event_id", F.round("value", 2).alias("best"))


@query("SELECT event_id, event_type, turn FROM (SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS turn FROM events) WHERE turn <= 3")
def interleaved_capsules(s, d):
    return windows.interleave(_t(s, d, "events"), "event_type", "event_type", [F.col("value").desc(), F.col("event_id")]).where("turn <= 3").select("event_id", "event_type", "turn")


@query("SELECT o_orderkey, round((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 10.0 / (count(*) OVER () - 1), 6) AS percentile_score FROM orders")
def percentile_rank_scores(s, d):
    return windows.percentile_rank(_t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", F.round("percentile_score", 6).alias("percentile_score"))


@query("SELECT DISTINCT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set_union_distinct(s, d):
    return _t(s, d, "orders").select(F.col("o_custkey").alias("k")).union(_t(s, d, "customer").select("c_custkey")).distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events")
def set_except_delta(s, d):
    return tables.export_delta(_t(s, d, "customer").select("c_custkey"), _t(s, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey")[0]


# ------------------------------------------------------------------------------------------ places


@query(f"SELECT CAST(round(lat / 11.25) AS BIGINT) AS y, CAST(round(lon / 11.25) AS BIGINT) AS x, count(*) AS n, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS best FROM {_CUSTOMERS} GROUP BY 1, 2")
def map_grid_clusters(s, d):
    return stats.map_clusters(_customers(s, d), "lat", "lon", 4, "c_custkey", "c_acctbal")


@query(f"SELECT c_custkey FROM {_CUSTOMERS} WHERE lat BETWEEN 48.8 - 1500 / 111.0 AND 48.8 + 1500 / 111.0 AND lon BETWEEN 2.3 - 1500 / (111.0 * greatest(cos(radians(48.8)), .01)) AND 2.3 + 1500 / (111.0 * greatest(cos(radians(48.8)), .01))")
def geo_box(s, d):
    return _customers(s, d).where(exprs.geo_box("lat", "lon", 48.8, 2.3, 1500)).select("c_custkey")


# ------------------------------------------------------------------------------------------ sessions


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS start FROM s GROUP BY 1, 2""")
def gap_sessions(s, d):
    return grouping.gap_sessions(_t(s, d, "events"), ["user_id"], "ts", "event_id", 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"))


@query("""WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap > 0),
a AS (SELECT user_id, greatest(1200, gap * 6) AS gap_s FROM r WHERE rn = n // 2 + 1),
e AS (SELECT e.*, CASE WHEN (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY e.user_id ORDER BY ts, event_id)) / 1e6 > coalesce(gap_s, 1200) THEN 1 ELSE 0 END AS nw FROM events e LEFT JOIN a USING (user_id)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scene FROM e)
SELECT user_id, CAST(scene AS BIGINT) AS scene, count(*) AS n, min(ts) AS start, max(ts) AS "end", arg_min(event_id, (-value, event_id)) AS best FROM s GROUP BY 1, 2 HAVING count(*) >= 2""")
def scenes_adaptive_gap(s, d):
    return grouping.scenes(_t(s, d, "events"), ["user_id"], "ts", "event_id", "value")


@query("""WITH b AS (SELECT event_type, event_id, ts, value, lag(ts) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
f AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(pt)) / 1e6 <= 1800 AND abs(value - pv) >= .5 THEN 0 ELSE 1 END AS nw FROM b), r AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM f),
st AS (SELECT *, value - lag(value) OVER (PARTITION BY event_type, run ORDER BY ts, event_id) AS step FROM r)
SELECT event_type, CAST(run AS BIGINT) AS run, count(*) AS n, round(max(value) - min(value), 6) AS span, min(event_id) AS first, max(event_id) AS last FROM st GROUP BY 1, 2 HAVING count(*) >= 3 AND (min(step) > 0 OR max(step) < 0) AND max(value) - min(value) >= 1 AND max(step) - min(step) <= 30""")
def bracket_runs(s, d):
    return grouping.bracket_runs(_t(s, d, "events"), ["event_type"], "ts", "event_id", "value", gap_s=1800, spread=30)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT user_id, arg_min(value, (epoch_us(ts), event_id)) AS base_ev, arg_min(event_id, (epoch_us(ts), event_id)) AS base FROM r WHERE rn = n // 2 + 1 OR (n % 2 = 0 AND rn = n // 2) GROUP BY 1)
SELECT e.event_id, b.base, round(b.base_ev - e.value, 6) AS ev_offset FROM events e JOIN b USING (user_id)""")
def bracket_base_offsets(s, d):
    return grouping.bracket_base(_t(s, d, "events"), "user_id", "ts", "event_id", "value").select("event_id", "base", F.round("ev_offset", 6).alias("ev_offset"))


@query("""WITH RECURSIVE p AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, (user_id % 20) * 6148914691236517 AS h, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
near AS (SELECT a.k, max(b.k) AS j FROM p a JOIN p b ON b.k < a.k AND b.t >= a.t - 600 WHERE bit_count(xor(a.h, b.h)) <= 16 OR a.t - b.t <= 5 AND bit_count(xor(a.h, b.h)) <= 32 GROUP BY 1),
x AS MATERIALIZED (SELECT p.k, coalesce(j, 0) AS j FROM p LEFT JOIN near USING (k)), r AS (SELECT 1::BIGINT AS k, 1::BIGINT AS start UNION ALL SELECT x.k, CASE WHEN x.j >= r.start THEN r.start ELSE x.k END FROM r JOIN x ON x.k = r.k + 1),
n AS (SELECT start, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 2)
SELECT event_id, min(event_id) OVER (PARTITION BY start) AS burst, n FROM r JOIN n USING (start) JOIN p USING (k)""")
def burst_runs(s, d):
    rows = _t(s, d, "events").withColumn("phash", (F.col("user_id") % 20) * 6148914691236517)
    return grouping.burst_runs(rows, "ts", "event_id", "phash", window_s=600.0, bits=16)


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) > 900000000 THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM g)
SELECT event_type, CAST(run AS BIGINT) AS run, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 8""")
def panorama_candidates(s, d):
    return grouping.panorama_candidates(_t(s, d, "events"), ["event_type"], "ts", "event_id", gap_s=900).groupBy("event_type", "run").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------ similarity

_E = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query(f"""WITH RECURSIVE e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id AND {_COS} >= 0.4), r(node, reach) AS (SELECT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x) SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def similarity_components(s, d):
    return grouping.components(similarity.linked_above(_t(s, d, "embeddings"), "vec_id", "embedding", 0.4))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS score FROM {_E} a JOIN {_E} b ON a.vec_id < b.vec_id AND {_COS} >= 0.45")
def near_duplicate_pairs(s, d):
    return similarity.pairs_above(_t(s, d, "embeddings"), "vec_id", "embedding", 0.45).select("a", "b", F.round("score", 6).alias("score"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS score FROM {_E} a JOIN {_E} b ON a.vec_id < b.vec_id AND a.label = b.label AND {_COS} >= 0.3")
def person_merge_pairs(s, d):
    return similarity.pairs_above(_t(s, d, "embeddings"), "vec_id", "embedding", 0.3, "label").select("a", "b", F.round("score", 6).alias("score"))


@query(f"SELECT a.vec_id, round({_COS}, 6) AS score FROM {_E} a JOIN {_E} b ON b.vec_id = 0 ORDER BY 2 DESC, 1 LIMIT 25")
def knn_exact(s, d):
    e = _t(s, d, "embeddings")
    return similarity.knn(e, "vec_id", "embedding", list(e.where("vec_id = 0").first()["embedding"]), 25)


@query(f"SELECT a.vec_id, round(.7 * (1 - bit_count(xor(a.vec_id, CAST(5 AS BIGINT))) / 64.0) + .3 * greatest(0, {_COS}), 6) AS score FROM {_E} a JOIN {_E} b ON b.vec_id = 5 WHERE a.vec_id <> 5 ORDER BY 2 DESC, 1 LIMIT 50")
def visual_similar_blend(s, d):
    e = _t(s, d, "embeddings")
    one = F.array(*(F.lit(float(x)) for x in e.where("vec_id = 5").first()["embedding"]))
    score = similarity.visual_blend(exprs.hamming(F.col("vec_id"), F.lit(5).cast("long")), exprs.cosine(F.col("embedding"), one))
    return e.where("vec_id <> 5").select("vec_id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(50)


@query(f"SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: least(abs(z[1]), abs(z[2])))), 6) AS score FROM {_E} a JOIN {_E} b ON b.vec_id = 3 ORDER BY 2 DESC, 1 LIMIT 30")
def colour_intersection(s, d):
    e = _t(s, d, "embeddings")
    one = F.array(*(F.lit(abs(float(x))) for x in e.where("vec_id = 3").first()["embedding"]))
    own = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return e.select("vec_id", F.round(similarity.histogram_intersection(own, one), 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(30)


_TOKENS = "(SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents)"


def _bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(terms))
    df = ", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (docs - df{i} + .5) / (df{i} + .5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (.25 + .75 * n / mean))" for i in range(len(terms)))
    return f"WITH r AS (SELECT doc_id, len(t) AS n, {tf} FROM {_TOKENS}), a AS (SELECT count(*) AS docs, avg(n) AS mean, {df} FROM r) SELECT doc_id, {score} AS score FROM r, a WHERE " + " OR ".join(f"tf{i} > 0" for i in range(len(terms)))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(['idiot', 'license'])})")
def bm25_search(s, d):
    return similarity.bm25(_t(s, d, "documents"), "doc_id", "text", ["idiot", "license"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(['idiot', 'license'])})")
def indexed_search(s, d):
    """The search over an index that was built from older texts, and brought up to date since."""
    t = _t(s, d, "documents")
    index = text_index.TextIndex(s, f"{tables.shared_folder(s)}/lumenfold-tables/{uuid.uuid4().hex}", "doc_id")
    tables.remove_at_end(s, index.folder)
    index.update(t.select(F.when(F.col("lang") == "en", F.col("doc_id")).otherwise(-1 - F.col("doc_id")).alias("doc_id"), F.concat(F.lit("idiot "), F.coalesce("text", F.lit(""))).alias("text")), "text")
    index.update(t, "text", removed=t.where("lang <> 'en' or lang is null").select((-1 - F.col("doc_id")).alias("doc_id")))
    return index.search(["idiot", "license"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH t AS ({_bm25_sql(['idiot', 'license'])}), n AS (SELECT doc_id AS k, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS t FROM t),
v AS (SELECT a.vec_id AS k, round({_COS}, 6) AS v FROM {_E} a JOIN {_E} b ON b.vec_id = 0 ORDER BY 2 DESC, 1 LIMIT 100)
SELECT k, round(.7 * coalesce(v, 0) + .3 * coalesce(t, 0), 6) AS score FROM v FULL JOIN n USING (k) ORDER BY 2 DESC, 1 LIMIT 40""")
def hybrid_search(s, d):
    e = _t(s, d, "embeddings")
    v = similarity.knn(e, "vec_id", "embedding", list(e.where("vec_id = 0").first()["embedding"]), 100).withColumnRenamed("vec_id", "k")
    return similarity.hybrid(v, similarity.bm25(_t(s, d, "documents"), "doc_id", "text", ["idiot", "license"]).withColumnRenamed("doc_id", "k"), "k", 40)


@query(f"SELECT a.vec_id, b.label, round(max({_COS}), 6) AS score FROM {_E} a JOIN {_E} b ON b.vec_id < 12 GROUP BY 1, 2")
def zero_shot_labels(s, d):
    e = _t(s, d, "embeddings")
    prompts = e.where("vec_id < 12").select("label", F.col("embedding").alias("prompt"))
    return similarity.zero_shot(e, "vec_id", "embedding", prompts).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH u AS (SELECT label, v, sqrt(list_dot_product(v, v)) AS n FROM {_E}), p AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(list_transform(v, lambda x: x / n)) AS x FROM u), m AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY 1, 2) SELECT label, round(sum(m * m), 6) AS square, count(*) AS dim FROM m GROUP BY 1")
def centroid_strength(s, d):
    parts = _t(s, d, "embeddings").select("label", F.posexplode(similarity.unit("embedding"))).groupBy("label", "pos").agg(F.avg("col").alias("m"))
    return parts.groupBy("label").agg(F.round(F.sum(F.col("m") * F.col("m")), 6).alias("square"), F.count("*").alias("dim"))


# ------------------------------------------------------------------------------------------ scoring and culling


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 45 AND l_discount <= .02 THEN 'bulk' WHEN l_returnflag = 'R' AND l_quantity < 10 THEN 'returned' WHEN l_extendedprice >= 50000 THEN 'premium' ELSE 'default' END AS category FROM lineitem")
def category_assignment(s, d):
    rules = {"premium": scoring.rule({"min_l_extendedprice": 50000}), "returned": scoring.rule({"l_returnflag": "R", "max_l_quantity": 9}), "bulk": scoring.rule({"min_l_quantity": 45, "max_l_discount": 0.02})}
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.category(rules, promote=("bulk", "returned")).alias("category"))


_AGG = "round(greatest(0, least(10, {0} * greatest(0, least(10, score)) + {1} * greatest(0, least(10, p_size / 5.0)) + {2} * greatest(0, least(10, hue / 36)) - CASE WHEN p_size > 45 THEN .5 ELSE 0 END)), 4)"


def _aggregate(p: DataFrame, percent: dict[str, float]) -> DataFrame:
    metrics = {"score": F.col("score"), "size": F.col("p_size") / 5.0, "hue": F.col("hue") / 36}
    value = scoring.aggregate_score(metrics, scoring.weights(percent), minus=F.when(F.col("p_size") > 45, 0.5).otherwise(0.0))
    return p.select("p_partkey", F.round(value, 4).alias("aggregate"))


@query(f"SELECT p_partkey, {_AGG.format('.5', '.3', '.2')} AS aggregate FROM {_PARTS}")
def aggregate_score(s, d):
    return _aggregate(_parts(s, d), {"score": 50, "size": 30, "hue": 20})


@query(f"SELECT p_partkey, {_AGG.format('.25', '.25', '.5')} AS aggregate FROM {_PARTS}")
def weights_preview(s, d):
    return _aggregate(_parts(s, d), {"score": 10, "size": 10, "hue": 20})


@query(f"""WITH p AS (SELECT * FROM {_PARTS}), g AS (SELECT p_brand, count(*) AS n, max(CASE WHEN rn = least(floor(c * .9), c - 1) + 1 THEN p_retailprice END) AS g FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS rn, count(*) OVER (PARTITION BY p_brand) AS c FROM p) GROUP BY 1 HAVING count(*) >= 50),
o AS (SELECT max(CASE WHEN rn = least(floor(c * .9), c - 1) + 1 THEN p_retailprice END) AS o FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice) AS rn, count(*) OVER () AS c FROM p))
SELECT p_partkey, round(greatest(0, least(10, p_retailprice / coalesce(g, o) * 10)), 4) AS norm FROM p LEFT JOIN g USING (p_brand), o""")
def normalised_metrics(s, d):
    p = _parts(s, d)
    by = stats.nearest_rank(p, ["p_brand"], "p_retailprice", [90], 50)
    overall = stats.nearest_rank(p.withColumn("all", F.lit(1)), ["all"], "p_retailprice", [90])
    return scoring.normalised(p, "p_brand", "p_retailprice", by, overall, "p90").select("p_partkey", F.round("p_retailprice_norm", 4).alias("norm"))


@query("SELECT event_id, rank <= 1 OR value >= best - 25 AS keep FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS best, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)")
def auto_keep_split(s, d):
    return culling.keep_split(_t(s, d, "events"), "user_id", "value", "event_id", -400.0).select("event_id", "keep")


@query("""WITH r AS (SELECT *, l_extendedprice / 10000 AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem), b AS (SELECT l_orderkey, p AS bp, l_discount AS bd FROM r WHERE rn = 1)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN bd - l_discount >= .03 THEN 'soft' WHEN bp - p >= 3 THEN 'overall' ELSE 'near_duplicate' END AS reason FROM r JOIN b USING (l_orderkey) WHERE rn > 1) GROUP BY 1""")
def cull_reasons(s, d):
    l = _t(s, d, "lineitem").withColumn("p", F.col("l_extendedprice") / 10000).withColumn("tie", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return culling.reject_reasons(l, "l_orderkey", "l_quantity", "tie", [("soft", "l_discount", 0.03), ("overall", "p", 3.0)]).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, round(.4 * score + .25 * (hue / 36) + .2 * (p_size / 5.0) + .15 * CASE WHEN p_size % 7 = 0 THEN 0 ELSE 10 END, 4) AS burst_score FROM {_PARTS}")
def burst_score_rank(s, d):
    p = _parts(s, d).withColumn("h", F.col("hue") / 36).withColumn("z", F.col("p_size") / 5.0).withColumn("b", (F.col("p_size") % 7 == 0).cast("int"))
    return p.select("p_partkey", F.round(culling.burst_score("score", "h", "z", "b"), 4).alias("burst_score"))


@query()
def mmr_select(s, d):
    e = _t(s, d, "embeddings").withColumn("quality", (F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 100.0))
    return culling.mmr(e, "label", "vec_id", "embedding", "quality", 12)


# ------------------------------------------------------------------------------------------ learning and checks


@query("""WITH k AS (SELECT *, value >= 20 AS keep FROM events), w AS (SELECT user_id, event_id AS winner, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS k FROM k WHERE keep), w2 AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS nk FROM w WHERE k < 2),
l AS (SELECT user_id, event_id AS loser, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS r FROM k WHERE NOT keep)
SELECT user_id, winner, loser FROM l JOIN w2 USING (user_id) WHERE r < 12 AND r % nk = k""")
def culling_pairs(s, d):
    e = _t(s, d, "events").withColumn("keep", F.col("value") >= 20)
    return learning.culling_pairs(e, "user_id", "event_id", "keep", [F.col("value").desc(), F.col("event_id")])


@query("SELECT a.p_partkey AS winner, b.p_partkey AS loser, a.p_size - b.p_size AS d_p_size, round(a.p_retailprice - b.p_retailprice, 4) AS d_price FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def pair_feature_diff(s, d):
    p = _t(s, d, "part")
    pairs = p.select(F.col("p_partkey").alias("winner"), (F.col("p_partkey") + 1).alias("loser"))
    return learning.pair_differences(pairs, p, "p_partkey", ["p_size", "p_retailprice"]).select("winner", "loser", "d_p_size", F.round("d_p_retailprice", 4).alias("d_price"))


@query(f"WITH b AS (SELECT least(4, floor(score / 2)) AS bin, sum(p_size) AS n FROM {_PARTS} GROUP BY 1) SELECT round(greatest(0, 100 - avg(abs(n - m) / m) * 100), 4) AS score, count(*) AS bins FROM b, (SELECT avg(n) AS m FROM b)")
def comparison_coverage(s, d):
    return learning.coverage(_parts(s, d), "score", "p_size")


@query("SELECT event_type, a, event_id AS b, round(value - pv, 6) AS gap FROM (SELECT *, lag(event_id) OVER w AS a, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)) WHERE a IS NOT NULL ORDER BY 4, 2, 3 LIMIT 100")
def uncertainty_pairs(s, d):
    return learning.uncertainty_pairs(_t(s, d, "events"), "event_type", "value", "event_id", 100)


@query("""WITH j AS (SELECT lang, toxic, n_chars FROM documents JOIN labels USING (doc_id)), r AS (SELECT lang, toxic, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM j), a AS (SELECT lang, sum(CASE WHEN toxic = 1 THEN r END) AS s, count_if(toxic = 1) AS p, count_if(toxic = 0) AS q FROM r GROUP BY 1)
SELECT lang, CASE WHEN p * q > 0 THEN round((s - p * (p + 1) / 2) / (p * q), 6) END AS auc, p, q FROM a""")
def auc_by_metric(s, d):
    return learning.auc(_t(s, d, "documents").join(_t(s, d, "labels"), "doc_id"), "toxic", "n_chars", ["lang"])


@query("""WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS x, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS y FROM part)
SELECT p_brand, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 10""")
def spearman_by_metric(s, d):
    return learning.spearman(_t(s, d, "part"), "p_size", "p_retailprice", ["p_brand"])


@query("SELECT l_orderkey, 'l_quantity' AS \"column\", l_quantity AS value FROM lineitem WHERE l_quantity > 48 OR l_quantity < 1 UNION ALL SELECT l_orderkey, 'l_discount', l_discount FROM lineitem WHERE l_discount > .09 OR l_discount < 0")
def dq_ranges(s, d):
    return quality.range_violations(_t(s, d, "lineitem"), "l_orderkey", {"l_quantity": (1, 48), "l_discount": (0, 0.09)})


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')")
def dq_orphans(s, d):
    return quality.orphans(_t(s, d, "orders").select("o_custkey", "o_orderkey"), _t(s, d, "customer").where("c_mktsegment <> 'MACHINERY'"), "o_custkey", "c_custkey")


@query("SELECT event_id, event_type, value FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) USING (event_type) WHERE abs(value - m) > 3 * s")
def dq_outliers(s, d):
    return quality.outliers(_t(s, d, "events"), "event_id", "value", "event_type")


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicate_keys(s, d):
    return quality.duplicate_keys(_t(s, d, "orders"), ["o_custkey", "o_orderstatus"])


# ------------------------------------------------------------------------------------------ functions


@query("""SELECT event_id, CAST(strftime(ts, '%W') AS INTEGER) AS week, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END AS season, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def date_functions(s, d):
    return _t(s, d, "events").select("event_id", exprs.monday_week("ts").alias("week"), exprs.season("ts").alias("season"), F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS slug, substr(md5(concat_ws('|', CAST(p_partkey AS VARCHAR), p_brand)), 1, 12) AS id, length(p_name) < 4 OR regexp_matches(regexp_replace(p_name, '[:\\- .]', '', 'g'), '^[0-9]*$') AS junk FROM part")
def text_functions(s, d):
    return _t(s, d, "part").select("p_partkey", exprs.slug("p_name").alias("slug"), exprs.stable_id("p_partkey", "p_brand").alias("id"), exprs.lens_is_junk("p_name").alias("junk"))


@query(f"SELECT a.c_custkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(48.8) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.8)) * pow(sin((radians(2.3) - radians(lon)) / 2), 2)))), 3) AS km FROM {_CUSTOMERS} a")
def haversine_distance(s, d):
    return _customers(s, d).select("c_custkey", F.round(exprs.haversine_km("lat", "lon", F.lit(48.8), F.lit(2.3)), 3).alias("km"))


@query("SELECT l_orderkey, l_linenumber, round(log2(l_quantity * l_quantity / (l_tax + 0.01)) - log2((l_discount + 0.01)), 4) AS ev FROM lineitem")
def exposure_values(s, d):
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(exprs.exposure_value("l_quantity", F.col("l_tax") + 0.01, (F.col("l_discount") + 0.01) * 100), 4).alias("ev"))


_BINS = "(SELECT vec_id, list_transform(list_concat(v, v, v, v), lambda x: abs(x)) AS b FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"


@query(f"SELECT vec_id, round(list_sum(b[1:64]), 6) AS first, round(list_sum(b[193:256]), 6) AS last, round(list_sum(b[1:30]) / list_sum(b), 6) AS shadow FROM {_BINS}")
def histogram_functions(s, d):
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = _t(s, d, "embeddings").select("vec_id", F.concat(v, v, v, v).alias("b"))
    four = images.downsampled("b", 4)
    return rows.select("vec_id", F.round(four[0], 6).alias("first"), F.round(four[3], 6).alias("last"), F.round(images.share("b", 0, 29), 6).alias("shadow"))


@query("SELECT s_suppkey AS person_id, s_name AS name, 0 AS is_hidden, count(l_orderkey) AS faces, count(DISTINCT l_orderkey) AS photos FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 5 <> 0 GROUP BY ALL")
def person_list(s, d):
    p = _t(s, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 5 == 0).cast("int").alias("is_hidden"))
    return persons.people(p, _t(s, d, "lineitem").select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("photo")))


@query("SELECT CASE WHEN l_suppkey IN (1, 2, 3) THEN 4 ELSE l_suppkey END AS person_id, count(*) AS n FROM lineitem GROUP BY 1")
def person_merge_chain(s, d):
    merges = s.createDataFrame([(2, 1), (1, 4), (3, 4)], "source long, target long")
    return persons.merged(_t(s, d, "lineitem").select(F.col("l_suppkey").alias("person_id")), merges).groupBy("person_id").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT l_partkey % 50 AS cluster, l_suppkey AS owner, count(*) AS n FROM lineitem GROUP BY 1, 2), z AS (SELECT l_partkey % 50 AS cluster, count(*) AS size FROM lineitem GROUP BY 1) SELECT cluster, owner FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, owner) AS rn FROM n) JOIN z USING (cluster) WHERE rn = 1 AND n >= .02 * size")
def cluster_owner_majority(s, d):
    return persons.majority_owner(_t(s, d, "lineitem").select((F.col("l_partkey") % 50).alias("cluster"), F.col("l_suppkey").alias("owner")), "cluster", "owner", 0.02)


@query("SELECT c_custkey, 'c_mktsegment' AS \"column\", c_mktsegment AS raw FROM customer")
def dq_type_corruption(s, d):
    return quality.type_corruption(_t(s, d, "customer"), "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("SELECT p_partkey, 'p_size' AS \"column\", CAST(p_size AS BIGINT) AS value FROM part WHERE p_size NOT IN (0, 1)")
def dq_flags(s, d):
    return quality.flag_violations(_t(s, d, "part"), "p_partkey", ["p_size"])


@query("SELECT o_orderkey, 'finished_is_old' AS rule FROM orders WHERE o_orderstatus = 'F' AND NOT o_orderdate < TIMESTAMP '1997-01-01' UNION ALL SELECT o_orderkey, 'urgent_is_dear' FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT o_totalprice >= 100000")
def dq_consistency(s, d):
    return quality.implications(_t(s, d, "orders"), "o_orderkey", {"finished_is_old": (F.col("o_orderstatus") == "F", F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")), "urgent_is_dear": (F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") >= 100000)})


@query("SELECT len(embedding) AS length, count(*) AS n FROM embeddings GROUP BY 1")
def dq_vector_lengths(s, d):
    return quality.vector_lengths(_t(s, d, "embeddings"), "embedding")


# ------------------------------------------------------------------------------------------ more of the above families


@query(f"SELECT vec_id, label AS guess, rank FROM (SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS INTEGER) AS rank, score FROM (SELECT a.vec_id, b.label, max({_COS}) AS score FROM {_E} a JOIN {_E} b ON b.vec_id < 12 GROUP BY 1, 2) WHERE score >= .15) WHERE rank <= 2")
def zero_shot_tags(s, d):
    e = _t(s, d, "embeddings")
    prompts = e.where("vec_id < 12").select("label", F.col("embedding").alias("prompt"))
    return similarity.top_labels(similarity.zero_shot(e, "vec_id", "embedding", prompts), "vec_id", 0.15, 2).select("vec_id", F.col("label").alias("guess"), "rank")


@query(f"""WITH z AS (SELECT a.vec_id, b.label, max({_COS}) AS score FROM {_E} a JOIN {_E} b ON b.vec_id < 12 GROUP BY 1, 2), f AS (SELECT vec_id, min(label) AS none FROM z GROUP BY 1),
k AS (SELECT vec_id, arg_max(label, score) FILTER (label <> 0) AS best, max(score) FILTER (label <> 0) AS top, max(score) FILTER (label = 0) AS other FROM z GROUP BY 1)
SELECT vec_id, CASE WHEN top >= .2 AND top - coalesce(other, -1) >= .05 THEN best ELSE 0 END AS kind FROM k""")
def contrast_classes(s, d):
    e = _t(s, d, "embeddings")
    prompts = e.where("vec_id < 12").select("label", F.col("embedding").alias("prompt"))
    return similarity.contrast_classify(similarity.zero_shot(e, "vec_id", "embedding", prompts), "vec_id", 0, 0.2, 0.05).select("vec_id", F.col("label").alias("kind"))


@query(f"SELECT a.vec_id, round((greatest(-1, least(1, {_COS})) + 1) * 5, 6) AS score FROM {_E} a JOIN {_E} b ON b.vec_id = 7")
def aesthetic_axis(s, d):
    e = _t(s, d, "embeddings")
    return e.select("vec_id", F.round(similarity.axis_score("embedding", list(e.where("vec_id = 7").first()["embedding"])), 6).alias("score"))


@query("""WITH v AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_returnflag AS u, CASE WHEN l_partkey <= l_suppkey THEN 'a' ELSE 'b' END AS w, l_orderkey * 10 + l_linenumber AS t FROM lineitem)
SELECT a, b, u AS user, max(t) AS at, arg_max(w, (t, w)) AS winner FROM v GROUP BY 1, 2, 3""")
def canonical_votes(s, d):
    v = _t(s, d, "lineitem").select("l_partkey", "l_suppkey", F.lit("a").alias("w"), F.col("l_returnflag").alias("user"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return learning.canonical_votes(v, "l_partkey", "l_suppkey", "w", "user", "at").select("a", "b", "user", "at", "winner")


@query("SELECT a.p_partkey AS winner, b.p_partkey AS loser, a.p_size - b.p_size AS gap FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size > b.p_size ORDER BY 3 DESC, 1, 2 LIMIT 200")
def rating_pairs(s, d):
    return learning.rating_pairs(_t(s, d, "part"), "p_brand", "p_partkey", "p_size", 200)


@query("SELECT n.p_brand, n.m AS mean, abs(n.m - o.m) > .1 * abs(o.m) AS stale FROM (SELECT p_brand, round(avg(p_size), 4) AS m FROM part GROUP BY 1) n JOIN (SELECT p_brand, round(avg(p_size), 4) AS m FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) o USING (p_brand)")
def percentile_drift(s, d):
    p = _t(s, d, "part")
    mean = lambda x: x.groupBy("p_brand").agg(F.round(F.avg("p_size"), 4).alias("mean"))
    return scoring.drift(mean(p), mean(p.where("p_partkey % 2 = 0")), ["p_brand"], "mean").select("p_brand", "mean", "stale")


@query("SELECT p_partkey, metric, round(value * weight, 4) AS contribution, CASE WHEN value >= 7.5 THEN 'strength' WHEN value < 5 THEN 'weakness' END AS verdict FROM (SELECT p_partkey, 'score' AS metric, score AS value, .6 AS weight FROM " + _PARTS + " UNION ALL SELECT p_partkey, 'size', p_size / 5.0, .4 FROM part)")
def score_critique(s, d):
    p = _parts(s, d).withColumn("size", F.col("p_size") / 5.0)
    return scoring.critique(p, "p_partkey", ["score", "size"], {"score": 0.6, "size": 0.4}).select("p_partkey", "metric", "contribution", "verdict")


@query("""WITH e AS (SELECT event_id, CASE WHEN value >= 20 THEN user_id END AS g1, hour(ts) AS g2, value FROM events), a AS (SELECT *, count(*) OVER (PARTITION BY g1) AS n, max(value) OVER (PARTITION BY g1) AS best, row_number() OVER (PARTITION BY g1 ORDER BY value DESC, event_id) AS r FROM e WHERE g1 IS NOT NULL),
d1 AS (SELECT event_id, r <= 1 OR value >= best - 5 AS keep FROM a WHERE n >= 2), b AS (SELECT *, count(*) OVER (PARTITION BY g2) AS n FROM e WHERE event_id NOT IN (SELECT event_id FROM d1)), c AS (SELECT *, max(value) OVER (PARTITION BY g2) AS best, row_number() OVER (PARTITION BY g2 ORDER BY value DESC, event_id) AS r FROM b WHERE n >= 2)
SELECT * FROM d1 UNION ALL SELECT event_id, r <= 1 OR value >= best - 5 FROM c""")
def auto_cull(s, d):
    e = _t(s, d, "events")
    first = e.where("value >= 20").select("event_id", F.col("user_id").alias("g"), "value")
    second = e.select("event_id", F.hour("ts").cast("long").alias("g"), "value")
    return culling.auto_cull([first, second], "event_id", "g", "value", 0.0)


@query("SELECT CAST(round(lat / 20) AS BIGINT) AS y, CAST(round(lon / 20) AS BIGINT) AS x, count(*) AS n FROM " + _CUSTOMERS + " GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY 3 DESC, 1, 2 LIMIT 50")
def location_grid(s, d):
    return stats.location_grid(_customers(s, d), "lat", "lon", 20.0, 3, 50)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderkey % 3 = 0")
def partial_upsert(s, d):
    o = _t(s, d, "orders").select("o_orderkey", "o_totalprice")
    return tables.upsert(o, o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), "o_orderkey", ["o_totalprice"])


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def newest_row(s, d):
    return tables.newest(_t(s, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey")), ["o_custkey"], "at").select("o_custkey", "o_orderkey")
