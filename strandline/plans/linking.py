"""Claims of lines about suppliers and parts, with orders as their evidence: outcomes, links and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import linking as op
from strandline.plans.graphs import _id
from strandline.plans.registry import load, query

#: The clauses of each relationship, and the sources that a method may have.
POLICY = (("A", "seen", "m1", "B"), ("A", "seen", "m2", "B"), ("A", "seen", "m3", "B"), ("A", "seen", "m4", "B"), ("N", "stated", "m1", "A"), ("N", "stated", "m5", "A"), ("N", "seen", "m2", "A"), ("N", "seen", "m3", "A"), ("N", "seen", "m5", "A"))
SOURCES = tuple((f"m{k}", s) for k in range(1, 6) for s in ("browser", "repository")) + (("m5", "document"),)


def _linked(spark, d) -> op.Linked:
    """Lines are claims; an order is evidence, bound to its lines' suppliers and parts. First lines cite the next order too, which may not exist."""
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    number = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    cites = F.when(F.col("l_linenumber") == 1, F.array(_id("o", "l_orderkey"), _id("o", F.col("l_orderkey") + 1))).otherwise(F.array(_id("o", "l_orderkey")))
    claims = li.select(
        number.alias("claim_id"), F.when(F.col("l_tax") >= 0.08, "other").otherwise("app").alias("application_id"), _id("s", F.col("l_suppkey") % 5).alias("from_id"), F.col("l_returnflag").alias("relationship"),
        _id("p", F.col("l_partkey") % 200).alias("to_id"), F.when(F.col("l_quantity") < 3, "contradicts").otherwise("supports").alias("assertion"), F.concat(F.lit("line "), "l_linenumber").alias("explanation"),
        (F.col("l_linenumber") <= 5).alias("submitted"), cites.alias("evidence_ids"),
    )
    bound = li.groupBy("l_orderkey").agg(F.collect_set(F.struct(_id("s", F.col("l_suppkey") % 5).alias("from_id"), F.col("l_returnflag").alias("relationship"), _id("p", F.col("l_partkey") % 200).alias("to_id"))).alias("bindings"))
    source = F.when(F.col("o_orderstatus") == "F", "browser").when(F.col("o_orderstatus") == "O", "repository").otherwise("document")
    evidence = o.join(bound, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        _id("o", "o_orderkey").alias("evidence_id"), F.when(F.col("o_totalprice") < 5000, "other").otherwise("app").alias("application_id"), F.when(F.col("o_totalprice") > 400000, "failed").otherwise("captured").alias("status"),
        F.concat(F.lit("m"), F.substring("o_orderpriority", 1, 1)).alias("method"), source.alias("source_kind"), _id("c", "o_custkey").alias("run_id"), F.when(F.col("o_totalprice") > 100000, F.substring("o_orderpriority", 3, 9)).alias("commit_sha"),
        F.lit(None).cast("string").alias("artifact_id"), F.col("o_orderdate").alias("captured_at"), "bindings",
    )
    policy = spark.createDataFrame(list(POLICY), "relationship string, clause string, method string, tier string")
    methods = spark.createDataFrame(list(SOURCES), "method string, source_kind string")
    runs = load(spark, d, "customer").where("c_acctbal > -500").select(_id("c", "c_custkey").alias("run_id"))
    commits = o.where("o_orderstatus = 'F' and o_orderpriority <> '3-MEDIUM'").select(F.substring("o_orderpriority", 3, 9).alias("commit_sha"))
    return op.link(claims, evidence, policy, "app", methods, runs, commits)


_LINKED = f"""
WITH pol(rel, clause, method, tier) AS (VALUES {", ".join(map(str, POLICY))}), src(method, source) AS (VALUES {", ".join(map(str, SOURCES))}),
c0 AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS claim_id, l_orderkey AS k, l_linenumber AS ln, CASE WHEN l_tax >= 0.08 THEN 'other' ELSE 'app' END AS app, 's' || (l_suppkey % 5) AS f, l_returnflag AS rel, 'p' || (l_partkey % 200) AS t,
  CASE WHEN l_quantity < 3 THEN 'contradicts' ELSE 'supports' END AS side FROM lineitem),
c AS (SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY app, f, rel, t, side) AS pick FROM c0) WHERE pick = 1),
e AS (SELECT 'o' || o_orderkey AS id, 'm' || o_orderpriority[1] AS method, o_orderdate AS captured, 'c' || o_custkey AS run, CASE WHEN o_totalprice > 100000 THEN substr(o_orderpriority, 3, 9) END AS sha, o_orderkey,
  CASE WHEN o_totalprice < 5000 THEN 'application_mismatch' WHEN o_totalprice > 400000 THEN 'invalid_evidence_status'
    WHEN ('m' || o_orderpriority[1], CASE o_orderstatus WHEN 'F' THEN 'browser' WHEN 'O' THEN 'repository' ELSE 'document' END) NOT IN (FROM src) THEN 'unsupported_source'
    WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500) THEN 'incompatible_run'
    WHEN o_totalprice > 100000 AND substr(o_orderpriority, 3, 9) NOT IN (SELECT substr(o_orderpriority, 3, 9) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '3-MEDIUM') THEN 'incompatible_commit' END AS code FROM orders),
x AS (SELECT claim_id, f, rel, t, 0 AS pos, 'o' || k AS id FROM c UNION ALL SELECT claim_id, f, rel, t, 1, 'o' || (k + 1) FROM c WHERE ln = 1),
b AS (SELECT DISTINCT 'o' || l_orderkey AS id, 's' || (l_suppkey % 5) AS f, l_returnflag AS rel, 'p' || (l_partkey % 200) AS t FROM lineitem),
a AS (SELECT claim_id, min({{'pos': pos, 'code': CASE WHEN e.id IS NULL THEN 'missing_evidence' ELSE code END}}) FILTER (e.id IS NULL OR code IS NOT NULL) AS bad, list(DISTINCT method) FILTER (method IS NOT NULL) AS methods, bool_and(b.id IS NOT NULL) AS bound
  FROM x LEFT JOIN e ON e.id = x.id LEFT JOIN b ON b.id = x.id AND b.f = x.f AND b.rel = x.rel AND b.t = x.t GROUP BY claim_id),
q AS (SELECT rel, list(ms) AS clauses, flatten(list(ms)) AS allowed, min(tier) AS tier FROM (SELECT rel, clause, list(method) AS ms, min(tier) AS tier FROM pol GROUP BY ALL) GROUP BY rel),
v AS (SELECT c.*, tier, CASE WHEN app <> 'app' THEN 'application_mismatch' WHEN bad IS NOT NULL THEN bad.code WHEN clauses IS NULL OR NOT list_has_all(allowed, coalesce(methods, [])) THEN 'unsupported_relationship_evidence'
  WHEN len(list_filter(clauses, lambda m: NOT list_has_any(m, coalesce(methods, [])))) > 0 THEN 'required_evidence_missing' WHEN ln <= 5 AND NOT bound THEN 'evidence_binding_mismatch' END AS code FROM c JOIN a USING (claim_id) LEFT JOIN q USING (rel)),
g AS (SELECT f, rel, t, bool_or(side = 'supports') AS s, bool_or(side = 'contradicts') AS k FROM v WHERE code IS NULL GROUP BY ALL)"""


@query(_LINKED + "SELECT claim_id, code, CASE WHEN code IS NOT NULL THEN 'rejected' WHEN s AND g.k THEN 'conflict' WHEN s THEN 'linked' ELSE 'open' END AS outcome FROM v LEFT JOIN g ON g.f = v.f AND g.rel = v.rel AND g.t = v.t")
def linked_claims(spark, d):
    """What becomes of every claim: a link, a conflict, a rejection with its first reason, or an open contradiction."""
    return _linked(spark, d).outcomes.select("claim_id", "outcome", "code")


@query(_LINKED + """, w AS (SELECT v.*, x.id, e.method, e.run, e.sha, e.captured FROM v JOIN g USING (f, rel, t) JOIN x USING (claim_id) JOIN e ON e.id = x.id WHERE v.code IS NULL AND s AND NOT g.k AND side = 'supports')
SELECT f AS from_id, rel AS relationship, t AS to_id, min(tier) AS tier, CASE WHEN count(DISTINCT method) = 1 THEN min(method) ELSE 'corroborated:' || array_to_string(list_sort(list(DISTINCT method)), '+') END AS extraction_method,
  substr(array_to_string(list_sort(list(DISTINCT 'line ' || ln)), ' | '), 1, 4096) AS explanation, array_to_string(list_sort(list(DISTINCT id)), ',') AS evidence_ids,
  CASE WHEN count(DISTINCT sha) = 1 THEN min(sha) END AS commit_sha, CASE WHEN count(DISTINCT run) = 1 THEN min(run) END AS run_id, max(captured) AS last_confirmed_at FROM w GROUP BY f, rel, t""")
def evidence_links(spark, d):
    """The links of all claims that hold, with tier, methods, explanations and evidence of their supporters."""
    x = _linked(spark, d).links
    return x.select("from_id", "relationship", "to_id", "tier", "extraction_method", "explanation", F.array_join("evidence_ids", ",").alias("evidence_ids"), "commit_sha", "run_id", "last_confirmed_at")


@query(_LINKED + """, w AS (SELECT v.*, x.id FROM v JOIN g USING (f, rel, t) JOIN x USING (claim_id) WHERE code IS NULL AND s AND g.k)
SELECT f AS from_id, rel AS relationship, t AS to_id, array_to_string(list_sort(list(DISTINCT claim_id) FILTER (side = 'supports')), ',') AS supporting, array_to_string(list_sort(list(DISTINCT claim_id) FILTER (side = 'contradicts')), ',') AS contradicting,
  array_to_string(list_sort(list(DISTINCT id)), ',') AS evidence_ids FROM w GROUP BY f, rel, t""")
def evidence_conflicts(spark, d):
    """Relationships that valid claims both support and contradict, with the claims of each side."""
    x = _linked(spark, d).conflicts
    return x.select("from_id", "relationship", "to_id", F.array_join("supporting", ",").alias("supporting"), F.array_join("contradicting", ",").alias("contradicting"), F.array_join("evidence_ids", ",").alias("evidence_ids"))
