"""Queries that group changes, score evaluations and write reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import reports as op, summaries
from strandline.plans.graphs import _BIPARTITE, blast_radius
from strandline.plans.registry import SQL, load, query


@query(f"""
WITH RECURSIVE {_BIPARTITE}, o AS (SELECT id // 2 AS l_orderkey, component AS c FROM cc WHERE id % 2 = 0), g AS (SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY c) AS component FROM o)
SELECT l_orderkey, component, ((row_number() OVER (PARTITION BY component ORDER BY l_orderkey) - 1) // 40)::INTEGER AS chunk FROM g
""")
def change_groups(spark, d):
    """Orders that share parts, directly or through others, in chunks of forty."""
    li = load(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("key"))
    units = li.select("l_orderkey").distinct().withColumn("size", F.lit(1.0))
    return op.group_changes(units, "l_orderkey", li, "size", 40).select("l_orderkey", "component", "chunk")


@query("""
WITH s AS (SELECT p_partkey, 0 AS rank FROM part WHERE p_brand = 'Brand#1' UNION ALL SELECT l_partkey, 1 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 UNION ALL SELECT p_partkey, 2 FROM part WHERE p_size < 5)
SELECT p_partkey, min(rank)::INTEGER AS rank FROM s GROUP BY p_partkey ORDER BY rank, p_partkey LIMIT 500
""")
def seed_map(spark, d):
    """Seeds from several sources with their best rank, at most five hundred (the size of a seed map)."""
    p, li = load(spark, d, "part"), load(spark, d, "lineitem")
    return op.seed_ranks([(0, p.where("p_brand = 'Brand#1'")), (1, li.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))), (2, p.where("p_size < 5"))], "p_partkey", 500)


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS i FROM lineitem WHERE l_returnflag = 'A'), p AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS i FROM lineitem WHERE l_discount < 0.05),
n AS (SELECT coalesce(e.c, p.c) AS c, count(*) FILTER (e.i IS NOT NULL AND p.i IS NOT NULL) AS tp, count(*) FILTER (e.i IS NULL) AS fp, count(*) FILTER (p.i IS NULL) AS fn FROM e FULL JOIN p ON e.c = p.c AND e.i = p.i GROUP BY 1),
r AS (SELECT c, CASE WHEN tp + fp = 0 THEN CASE WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS q, CASE WHEN tp + fp = 0 THEN 0.0 ELSE fp / (tp + fp) END AS far FROM n)
SELECT c AS l_suppkey, round((p + q + CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END + 1 - far) / 4, 6) AS score FROM r
""")
def case_score(spark, d):
    """Suppliers as cases: the mean of precision, recall, F1 and the false acceptance rate turned round."""
    li = load(spark, d, "lineitem")
    m = summaries.ratios(summaries.classify(li.where("l_returnflag = 'A'"), li.where("l_discount < 0.05"), "l_suppkey", "l_partkey"))
    m = m.withColumn("far", F.when(F.col("tp") + F.col("fp") == 0, 0.0).otherwise(F.col("fp") / (F.col("tp") + F.col("fp"))))
    s = op.case_scores(m, ["l_suppkey"], ["precision", "recall", "f1", "far"], {"far"})
    return s.withColumn("score", F.round("score", 6))


@query("""
WITH v AS (SELECT 'price' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT 'key', (o_orderkey % 97)::DOUBLE FROM orders)
SELECT metric, count(*) AS n, min(value) AS least, max(value) AS greatest, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS deviation, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM v GROUP BY metric
""")
def metric_distribution(spark, d):
    """Distributions of several metrics from one pass."""
    o = load(spark, d, "orders").select(F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 97).alias("key"))
    x = op.metric_distributions(o, ["price", "key"])
    return x.withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS i FROM lineitem WHERE l_returnflag <> 'N'), p AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS i FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag <> 'N')
SELECT coalesce(e.c, p.c) AS l_orderkey, count(*) FILTER (e.i IS NULL OR p.i IS NULL) = 0 AS exact FROM e FULL JOIN p ON e.c = p.c AND e.i = p.i GROUP BY 1
""")
def citation_exact(spark, d):
    """Orders whose cited suppliers are exactly the expected ones."""
    li = load(spark, d, "lineitem")
    return op.citation_accuracy(li.where("l_returnflag <> 'N'"), li.where("l_linestatus = 'F' or l_returnflag <> 'N'"), "l_orderkey", "l_suppkey")


_FOUND = SQL["blast_radius"].strip()


@query(f"""
WITH found AS ({_FOUND}), s AS (SELECT *, CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS section FROM found)
SELECT section::INTEGER AS section, row_number() OVER (PARTITION BY section ORDER BY score DESC, strength, target_id)::INTEGER AS line, '- **' || title || '** (' || target_kind || '): ' || risk || ' risk, score ' || score || ', evidence ' || strength AS text FROM s
UNION ALL SELECT * FROM (VALUES (0, 0, '## High risk'), (1, 0, '## Medium risk'), (2, 0, '## Low risk')) v(section, line, text)
""")
def impact_report(spark, d):
    """The impact report as Markdown, line by line."""
    risk = lambda r: F.col("risk") == r
    return op.markdown_report(blast_radius(spark, d), [F.desc("score"), "strength", "target_id"], [("High risk", risk("high")), ("Medium risk", risk("medium")), ("Low risk", risk("low"))])


@query(f"""
WITH found AS ({_FOUND}), g AS (SELECT count(*) FILTER (risk = 'high') AS high, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk = 'low') AS low FROM found)
SELECT *, CASE WHEN high > 0 THEN 'action_required' WHEN medium > 0 THEN 'neutral' ELSE 'success' END AS outcome FROM g
""")
def impact_check(spark, d):
    """The outcome of the impact check with counts by risk."""
    return op.check_outcome(blast_radius(spark, d))


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(?:www\.)?([^/?#]+/[^/?#]+)', 1)) AS repository_key, regexp_replace(regexp_replace(url, '[0-9]+', '{n}', 'g'), '[?].*$', '') AS volatile_free FROM pages
""")
def identifier_keys(spark, d):
    """Normal forms of identifiers: host and first segment without www, and an address without what changes."""
    u = F.col("url")
    return load(spark, d, "pages").select("page_id", F.lower(F.regexp_extract(u, r"^[a-z]+://(?:www\.)?([^/?#]+/[^/?#]+)", 1)).alias("repository_key"), F.regexp_replace(F.regexp_replace(u, "[0-9]+", "{n}"), "[?].*$", "").alias("volatile_free"))
