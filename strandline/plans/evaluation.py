"""Suppliers as golden cases, their lines of both statuses as two observed runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import evaluation as op, summaries
from strandline.plans.registry import load, query


def _evaluated(spark, d):
    """Expected of a supplier: facts are parts returned, links parts bought dear (negative ones cheap, critical if very cheap), impacted the orders of
    accepted lines, controls those of no such line. Observed by line status: what its lines of little discount say."""
    li = load(spark, d, "lineitem")
    case, text = F.col("l_suppkey").cast("string").alias("case_id"), lambda c: F.col(c).cast("string")
    s = load(spark, d, "supplier")
    cases = s.select(F.col("s_suppkey").cast("string").alias("case_id"), F.lit(0).alias("max_unnecessary"), F.array(F.lit("F")).alias("accepted_statuses"), F.create_map(F.lit("lines"), F.lit(400.0)).alias("budget"),
                     F.create_map(F.lit("case_score"), F.lit(0.7)).alias("minimum"), F.create_map(F.lit("false_acceptance_rate"), F.lit(0.9)).alias("maximum"))
    item = lambda df, field, ident, critical=F.lit(False): df.select(case, F.lit(field).alias("field"), text(ident).alias("id"), critical.alias("critical"))
    price = li.groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("p"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    per = li.groupBy("l_suppkey", "l_orderkey").agg(F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"))
    items = item(price.where("r = 1"), "fact", "l_partkey").union(item(price.where("p >= 40000"), "link", "l_partkey")).union(item(price.where("p < 20000"), "negative", "l_partkey", F.col("p") < 1500))
    items = items.union(item(per.where("a = 1"), "impact", "l_orderkey")).union(item(per.where("a = 0"), "control", "l_orderkey"))
    rep = F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("repetition")
    low = li.where("l_discount < 0.06")
    seen = lambda field, ident: low.select(case, rep, F.lit(field).alias("field"), text(ident).alias("id"))
    runs = li.groupBy("l_suppkey", "l_linestatus").agg(F.count("*").cast("double").alias("n")).select(case, rep, F.col("l_linestatus").alias("terminal_status"), F.create_map(F.lit("lines"), "n").alias("usage"))
    none = lambda schema: spark.createDataFrame([], schema)
    golden = op.Golden(cases, items, none("case_id string, claim_id string, evidence_ids array<string>, critical boolean"), none("case_id string, path_id string, node_ids array<string>"), none("case_id string, key string, value string"),
                       none("case_id string, phase int, step_ids array<string>, any_order boolean"), none("case_id string, step_id string, rule string"))
    run = "case_id string, repetition int, "
    observed = op.Observed(runs, seen("fact", "l_partkey").union(seen("link", "l_partkey")).union(seen("impact", "l_orderkey")), none(run + "claim_id string, evidence_ids array<string>, supported boolean, critical boolean"),
                           none(run + "path_id string, node_ids array<string>"), none(run + "key string, value string"), none(run + "pos int, step_id string, scope_allowed boolean, evidence_correct boolean, unsafe boolean"))
    return op.evaluate(golden, observed)


_SCORES = """
WITH i AS (SELECT l_suppkey AS s, l_partkey AS id, max(l_extendedprice) AS p, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL), o AS (SELECT l_suppkey AS s, l_orderkey AS id, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY ALL),
e AS (SELECT s, 'fact' AS f, id, false AS crit FROM i WHERE r UNION ALL SELECT s, 'link', id, false FROM i WHERE p >= 40000 UNION ALL SELECT s, 'negative', id, p < 1500 FROM i WHERE p < 20000
  UNION ALL SELECT s, CASE WHEN a THEN 'impact' ELSE 'control' END, id, false FROM o),
run AS (SELECT l_suppkey AS s, l_linestatus AS st, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT DISTINCT s, st, f, id FROM (SELECT l_suppkey AS s, l_linestatus AS st, unnest(['fact', 'link', 'negative']) AS f, l_partkey AS id FROM lineitem WHERE l_discount < 0.06
  UNION ALL SELECT l_suppkey, l_linestatus, unnest(['impact', 'control']), l_orderkey FROM lineitem WHERE l_discount < 0.06)),
x AS (SELECT coalesce(e.s, g.s) AS s, coalesce(e.st, g.st) AS st, coalesce(e.f, g.f) AS f, e.id IS NOT NULL AS e, g.id IS NOT NULL AS o, coalesce(crit, false) AS crit FROM (SELECT run.st, e.* FROM run JOIN e USING (s)) e FULL JOIN g ON g.s = e.s AND g.st = e.st AND g.f = e.f AND g.id = e.id),
c AS (SELECT s, st, f, count(*) FILTER (e)::DOUBLE AS e, count(*) FILTER (o)::DOUBLE AS o, count(*) FILTER (e AND o)::DOUBLE AS b, count(*) FILTER (e AND o AND crit) AS bad FROM x GROUP BY ALL),
w AS (SELECT run.s, run.st, run.n, coalesce(max(bad) FILTER (f = 'negative'), 0) AS bad,
  """ + ", ".join(f"coalesce(max({n}) FILTER (f = '{f}'), 0) AS {f}_{n}" for f in ("fact", "link", "negative", "impact", "control") for n in "eob") + """ FROM run LEFT JOIN c USING (s, st) GROUP BY ALL),
m AS (SELECT s, st, n, bad, CASE WHEN fact_o = 0 THEN (fact_e = 0)::INT ELSE fact_b / fact_o END AS fp, CASE WHEN fact_e = 0 THEN 1 ELSE fact_b / fact_e END AS fr, CASE WHEN link_o = 0 THEN (link_e = 0)::INT ELSE link_b / link_o END AS lp,
  CASE WHEN link_e = 0 THEN 1 ELSE link_b / link_e END AS lr, CASE WHEN negative_e = 0 THEN 0 ELSE negative_b / negative_e END AS far, CASE WHEN impact_e = 0 THEN 1 ELSE impact_b / impact_e END AS ir,
  CASE WHEN impact_o = 0 THEN (impact_e = 0)::INT ELSE impact_b / impact_o END AS ip, CASE WHEN control_e = 0 THEN 0 ELSE control_b / control_e END AS cfp, (st = 'F')::INT AS term, (n <= 400)::INT AS bud FROM w),
z AS (SELECT *, (fp + fr + CASE WHEN fp + fr = 0 THEN 0 ELSE 2 * fp * fr / (fp + fr) END + lp + lr + 1 - far + ir + ip + 1 - cfp + term + bud + 9) / 20 AS score FROM m)
"""


@query(_SCORES + "SELECT s::VARCHAR AS case_id, CASE st WHEN 'F' THEN 1 ELSE 2 END AS repetition, round(score, 9) AS score, bad AS hard_failures, bad = 0 AND score >= 0.7 AND far <= 0.9 AS passed FROM z")
def evaluation_results(spark, d):
    """Score, hard failures and verdict of every case and run, from all twenty metrics."""
    return _evaluated(spark, d)[2].withColumn("score", F.round("score", 9))


@query()
def evaluation_report(spark, d):
    """The report of the evaluation as Markdown, a row a line (its metrics are tested against plain Python)."""
    metrics, _, results = _evaluated(spark, d)
    return op.report(results, summaries.distribution(metrics, "metric", "value"), "Evaluation of suppliers")
