"""The coverage matrix of a graph made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import coverage as op
from strandline.operators.graphs import EDGES_OF_A_TASK
from strandline.plans.graphs import _id
from strandline.plans.registry import load, query


def _matrix(spark, d):
    """Customers are requirements, covered by their orders (workflows); an order stands on the screens of all its lines' suppliers, suppliers bind
    the parts of all their lines (symbols), nations (endpoints) of the first three regions are handled by a part. Returned lines are stale
    evidence; orders of status P are pending links."""
    p, o, li, c, s, n = (load(spark, d, t) for t in ("part", "orders", "lineitem", "customer", "supplier", "nation"))
    none, no = F.array().cast("array<string>"), F.lit(False)
    entity = lambda df, ident, kind, behavioral=no, changed=no: df.select(ident.alias("id"), F.lit(kind).alias("kind"), none.alias("evidence_ids"), behavioral.alias("behavioral"), changed.alias("changed"))
    e = entity(c, _id("c", "c_custkey"), "requirement").union(entity(o, _id("o", "o_orderkey"), "workflow")).union(entity(s, _id("s", "s_suppkey"), "screen")).union(entity(n, _id("n", "n_nationkey"), "api-endpoint"))
    e = e.union(entity(p, _id("p", "p_partkey"), "code-symbol", F.col("p_size") > 5, F.col("p_size") == 50))
    link = lambda df, a, b, rel, tier=F.lit("A"), review=F.lit("accepted"), ev=none: df.select(F.concat_ws(">", F.lit(rel), a, b).alias("id"), a.alias("from_id"), b.alias("to_id"), F.lit(rel).alias("relationship"), tier.alias("tier"), review.alias("review_state"), ev.alias("evidence_ids"))
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", "D").when(F.col("o_orderpriority") == "2-HIGH", "C").otherwise("B")
    covered = link(o, _id("c", "o_custkey"), _id("o", "o_orderkey"), "COVERED_BY", tier, F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("pending"))
    pending = link(o.where("o_orderstatus = 'P'"), _id("c", "o_custkey"), _id("o", "o_orderkey"), "COVERED_BY", F.lit("A"), F.lit("not_required"))
    tasks = li.count() // EDGES_OF_A_TASK + 1
    flags = lambda *keys: li.repartition(tasks, *keys).groupBy(*keys).agg(F.collect_set("l_returnflag").alias("ev"))
    screens, binds = flags("l_orderkey", "l_suppkey"), flags("l_suppkey", "l_partkey")
    links = [covered.union(link(n.where("n_regionkey < 3"), _id("n", "n_nationkey"), _id("p", F.col("n_nationkey") + 1), "HANDLED_BY"))]
    links += [link(screens, _id("o", "l_orderkey"), _id("s", "l_suppkey"), "ON_SCREEN", ev=F.col("ev")), link(binds, _id("s", "l_suppkey"), _id("p", "l_partkey"), "BINDS", ev=F.col("ev"))]
    stale = spark.createDataFrame([("R",)], "evidence_id string")
    conflicts = c.where("c_acctbal < -500").select(_id("x", "c_custkey").alias("id"), _id("c", "c_custkey").alias("from_id"), _id("n", "c_nationkey").alias("to_id"))
    candidates = s.select(_id("y", "s_suppkey").alias("id"), _id("s", "s_suppkey").alias("from_id"), _id("n", "s_nationkey").alias("to_id"), F.when(F.col("s_acctbal") < 5000, "rejected").alias("disposition"))
    reviewed = c.where("c_mktsegment = 'BUILDING'").select(F.lit("conflict").alias("target_kind"), _id("x", "c_custkey").alias("target_id"))
    return op.matrix(e, links, pending, stale, conflicts, candidates, reviewed)


_MATRIX = """
WITH RECURSIVE lk AS (SELECT 'COVERED_BY' AS rel, 'c' || o_custkey AS f, 'o' || o_orderkey AS t, CASE WHEN o_orderstatus = 'P' THEN true WHEN o_orderpriority = '1-URGENT' THEN false WHEN o_orderstatus = 'F' THEN true ELSE false END AS ok, false AS old FROM orders
  UNION ALL SELECT 'ON_SCREEN', 'o' || l_orderkey, 's' || l_suppkey, NOT bool_or(l_returnflag = 'R'), bool_or(l_returnflag = 'R') FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'BINDS', 's' || l_suppkey, 'p' || l_partkey, NOT bool_or(l_returnflag = 'R'), bool_or(l_returnflag = 'R') FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'HANDLED_BY', 'n' || n_nationkey, 'p' || (n_nationkey + 1), true, false FROM nation WHERE n_regionkey < 3),
g AS (SELECT * FROM lk WHERE ok), b AS (SELECT rel, f AS src, t AS dst FROM g UNION ALL SELECT rel, t, f FROM g),
en AS (SELECT 'c' || c_custkey AS id, 'requirement' AS kind, false AS beh, false AS chg FROM customer UNION ALL SELECT 'o' || o_orderkey, 'workflow', false, false FROM orders UNION ALL SELECT 's' || s_suppkey, 'screen', false, false FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'api-endpoint', false, false FROM nation UNION ALL SELECT 'p' || p_partkey, 'code-symbol', p_size > 5, p_size = 50 FROM part),
goals(q, letters, deep, rels) AS (VALUES ('ui', ['s'], 4, ['ON_SCREEN']), ('code', ['p'], 8, ['ON_SCREEN', 'BINDS', 'HANDLED_BY']), ('intent', ['c'], 8, ['ON_SCREEN', 'BINDS', 'HANDLED_BY', 'COVERED_BY']), ('product', ['c', 'o', 's'], 8, ['ON_SCREEN', 'BINDS', 'HANDLED_BY', 'COVERED_BY'])),
w(q, id, dist) AS (SELECT q, en.id, 0 FROM goals JOIN en ON list_contains(letters, en.id[1]) UNION SELECT w.q, b.src, dist + 1 FROM w JOIN goals USING (q) JOIN b ON b.dst = w.id AND list_contains(rels, b.rel) WHERE dist < deep),
near AS (SELECT DISTINCT q, id FROM w WHERE dist > 0),
gaps AS (SELECT 'requirement_without_workflow' AS kind, id AS subject_id, NULL AS target_id, false AS human FROM en WHERE kind = 'requirement' AND id NOT IN (SELECT f FROM g WHERE rel = 'COVERED_BY')
  UNION ALL SELECT 'workflow_without_ui', id, NULL, false FROM en WHERE kind = 'workflow' AND id NOT IN (SELECT id FROM near WHERE q = 'ui') UNION ALL SELECT 'workflow_without_code', id, NULL, false FROM en WHERE kind = 'workflow' AND id NOT IN (SELECT id FROM near WHERE q = 'code')
  UNION ALL SELECT 'endpoint_without_code', id, NULL, false FROM en WHERE kind = 'api-endpoint' AND id NOT IN (SELECT f FROM g WHERE rel = 'HANDLED_BY') UNION ALL SELECT 'code_without_intent', id, NULL, false FROM en WHERE kind = 'code-symbol' AND beh AND id NOT IN (SELECT id FROM near WHERE q = 'intent')
  UNION ALL SELECT 'changed_symbol_without_product_path', id, NULL, false FROM en WHERE kind = 'code-symbol' AND beh AND chg AND id NOT IN (SELECT id FROM near WHERE q = 'product')
  UNION ALL SELECT 'conflict', 'c' || c_custkey, 'n' || c_nationkey, true FROM customer WHERE c_acctbal < -500 AND c_mktsegment <> 'BUILDING' UNION ALL SELECT 'human_review_required', 's' || s_suppkey, 'n' || s_nationkey, true FROM supplier WHERE s_acctbal >= 5000
  UNION ALL SELECT DISTINCT 'stale_evidence', x, NULL, false FROM (SELECT unnest([f, t]) AS x FROM lk WHERE old))"""


@query(_MATRIX + " SELECT kind, subject_id, target_id, human AS requires_human FROM gaps")
def coverage_gap_rows(spark, d):
    """Every gap of the coverage matrix, by kind and subject."""
    return _matrix(spark, d)[0].select("kind", "subject_id", "target_id", "requires_human")


@query(_MATRIX + """ SELECT (SELECT count(*) FROM en) AS entities, (SELECT count(*) FROM customer) AS requirements, (SELECT count(*) FROM orders) AS workflows, (SELECT count(*) FROM nation) AS api_endpoints, (SELECT count(*) FROM part) AS code_symbols,
  (SELECT count(*) FROM g) AS confident_links, count(*) FILTER (kind <> 'stale_evidence') + max((kind = 'stale_evidence')::INT) AS gaps, count(*) FILTER (human) AS human_gaps, CASE WHEN bool_or(human) THEN 'needs_human' ELSE 'needs_reconciliation' END AS readiness FROM gaps""")
def coverage_matrix_stats(spark, d):
    """The coverage matrix in numbers, and whether it is ready."""
    return _matrix(spark, d)[1]
