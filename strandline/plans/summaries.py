"""Queries that aggregate."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import rows, summaries as op
from strandline.plans.registry import load, query

#: The event types that the counts are filled over; the last never occurs.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view", "refund")


@query("SELECT event_type, count(event_id)::BIGINT AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund')) v(event_type) LEFT JOIN events USING (event_type) GROUP BY event_type")
def counts_zero_filled(spark, d):
    """Events by type, types without events included."""
    return op.zero_filled(spark.createDataFrame([(x,) for x in EVENT_TYPES], "event_type string"), load(spark, d, "events"), "event_type")


@query("""
WITH x AS (SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
  count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS open_orders
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey)
SELECT *, CASE WHEN orders = 0 THEN 'not_evaluated' WHEN open_orders > 0 THEN 'partial' WHEN parts = 0 THEN 'not_observed' ELSE 'observed' END AS status FROM x
""")
def coverage_rollup(spark, d):
    """Each customer's distinct orders, parts and suppliers with a status by precedence."""
    o, li = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    x = load(spark, d, "customer").select("c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    # sizes of distinct sets by customer: one pass, where several distinct counts would expand every row
    x = x.groupBy("c_custkey").agg(*[F.size(F.collect_set(c)).cast("bigint").alias(n) for c, n in (("o_orderkey", "orders"), ("l_partkey", "parts"), ("l_suppkey", "suppliers"))], F.size(F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")))).cast("bigint").alias("open_orders"))
    status = rows.first_match([(F.col("orders") == 0, "not_evaluated"), (F.col("open_orders") > 0, "partial"), (F.col("parts") == 0, "not_observed")], "observed")
    return x.withColumn("status", status)


@query("""
SELECT l_orderkey, count(DISTINCT l_linenumber) AS steps, count(DISTINCT l_suppkey) AS suppliers, bool_or(l_returnflag = 'R') AS has_return,
  array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS tiers FROM lineitem GROUP BY l_orderkey
""")
def workflow_rollup(spark, d):
    """Orders as workflows: distinct steps and suppliers, and the set of tiers in order."""
    x = load(spark, d, "lineitem").groupBy("l_orderkey")
    return x.agg(F.size(F.collect_set("l_linenumber")).cast("bigint").alias("steps"), F.size(F.collect_set("l_suppkey")).cast("bigint").alias("suppliers"), F.bool_or(F.col("l_returnflag") == "R").alias("has_return"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("tiers"))


@query("""
SELECT l_partkey, l_suppkey, count(*) FILTER (l_returnflag = 'A') AS supports, count(*) FILTER (l_returnflag = 'R') AS contradicts,
  CASE WHEN supports > 0 AND contradicts > 0 THEN 'conflict' WHEN supports > 0 THEN 'link' WHEN contradicts > 0 THEN 'rejected' ELSE 'silent' END AS outcome
FROM lineitem GROUP BY l_partkey, l_suppkey
""")
def supports_contradicts(spark, d):
    """Claims on (part, supplier): link, conflict, rejected or silent."""
    return op.settle_claims(load(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], F.col("l_returnflag") == "A", F.col("l_returnflag") == "R")


@query("""
WITH s AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks, sum(CASE WHEN event_type = 'view' THEN 2 ELSE 1 END)::BIGINT AS units FROM events GROUP BY user_id),
l AS (SELECT *, greatest(0, 60 - clicks)::BIGINT AS clicks_left, greatest(0, 200 - units)::BIGINT AS units_left FROM s)
SELECT *, (clicks_left // 3)::BIGINT AS clicks_share, (units_left // 3)::BIGINT AS units_share FROM l
""")
def vector_budget_sum(spark, d):
    """Budgets of several counters: used, left, and an even split of what is left."""
    e = load(spark, d, "events").select("user_id", (F.col("event_type") == "click").cast("int").alias("clicks"), F.when(F.col("event_type") == "view", 2).otherwise(1).alias("units"))
    return op.merge_budgets(e, ["user_id"], ["clicks", "units"], {"clicks": 60, "units": 200}, 3)


@query("""
WITH e AS (SELECT DISTINCT d.lang, d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1),
p AS (SELECT DISTINCT d.lang, d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.n_chars >= 400),
c AS (SELECT coalesce(e.lang, p.lang) AS lang, count(*) FILTER (e.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp,
  count(*) FILTER (e.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn
  FROM e FULL JOIN p ON e.lang IS NOT DISTINCT FROM p.lang AND e.doc_id = p.doc_id GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN CASE WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS q FROM c)
SELECT lang, tp, fp, fn, round(p, 6)::DOUBLE AS "precision", round(q, 6)::DOUBLE AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6)::DOUBLE AS f1 FROM r
""")
def precision_recall_f1(spark, d):
    """A length rule as a prediction of the labels of quality, by language."""
    x = load(spark, d, "documents").select("doc_id", "lang", "n_chars").join(load(spark, d, "labels"), "doc_id")
    c = op.ratios(op.classify(x.where("quality = 1"), x.where("n_chars >= 400"), "lang", "doc_id"))
    return c.select("lang", "tp", "fp", "fn", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")])


@query("""
SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation,
  quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type
""")
def distribution_nearest_rank(spark, d):
    """The distribution of values by event type; percentiles are exact nearest ranks."""
    x = op.distribution(load(spark, d, "events"), "event_type", "value")
    return x.withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("""
WITH f AS (SELECT user_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events)
SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type = first THEN 1.0 ELSE 0.0 END), 6) AS share FROM f GROUP BY user_id
""")
def stability_first_value(spark, d):
    """The share of each user's events that are like the first one."""
    x = op.share_equal_first(load(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])
    return x.withColumn("share", F.round("share", 6))


@query("""
SELECT event_type, count(*) AS units, round(sum(v), 4) AS total FROM
  (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS v FROM events GROUP BY user_id, event_type) GROUP BY event_type
""")
def latest_then_sum(spark, d):
    """The newest value of each (user, type), summed by type."""
    x = op.latest_then_sum(load(spark, d, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"], "event_type")
    return x.withColumn("total", F.round("total", 4))


@query(r"""
WITH p AS (SELECT list_filter(string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages),
e AS (SELECT array_to_string(s[1:i], '/') AS module, array_to_string(s[1:i - 1], '/') AS up, i = len(s) AS own FROM p, unnest(range(1, len(s) + 1)) t(i)),
k AS (SELECT up AS module, count(*) AS children FROM (SELECT DISTINCT module, up FROM e) GROUP BY up)
SELECT module, files, coalesce(children, 0)::BIGINT AS children FROM (SELECT module, count(*) FILTER (own) AS files FROM e GROUP BY module) LEFT JOIN k USING (module)
""")
def directory_rollup(spark, d):
    """Modules of page addresses: pages directly at each, and modules directly below it."""
    p = load(spark, d, "pages").select(F.array_join(F.filter(F.split(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/"), lambda x: x != ""), "/").alias("path"))
    up = F.regexp_replace("module", "/?[^/]*$", "")
    return op.direct_counts(p, "path", rows.ancestors(F.col("path")), up)
