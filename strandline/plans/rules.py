"""Queries of the rule engine, linking, refresh planning and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.tables import cut
from strandline.operators import publish, rows, rules as op
from strandline.plans.registry import load, query

#: The checkpoints of the verdict query, as (id, operator, expected).
CHECKS = (("spend", "matches", "^[1-9][0-9]*$"), ("signup", "present", ""), ("refund", "absent", ""), ("first", "status_in", "view,click,signup"), ("last", "equals", "purchase"), ("drift", "unchanged", ""), ("move", "changed", ""))
_CHECKS = ", ".join("('{}', '{}', '{}')".format(*c) for c in CHECKS)


@query(f"""
WITH u AS (SELECT user_id, min_by(event_type, (ts, event_id)) AS first, max_by(event_type, (ts, event_id)) AS last, floor(sum(value) / 100)::BIGINT AS spend, count(*) FILTER (event_type = 'signup') AS signups FROM events GROUP BY user_id),
o AS (SELECT user_id, 'spend' AS checkpoint_id, spend::VARCHAR AS value, NULL AS before FROM u UNION ALL SELECT user_id, 'signup', signups::VARCHAR, NULL FROM u WHERE signups > 10
  UNION ALL SELECT user_id, 'first', first, NULL FROM u UNION ALL SELECT user_id, 'last', last, NULL FROM u UNION ALL SELECT user_id, 'drift', last, first FROM u UNION ALL SELECT user_id, 'move', last, first FROM u),
r AS (SELECT m.user_id, c.id, CASE WHEN o.user_id IS NULL AND op <> 'absent' THEN 'blocked' WHEN CASE op WHEN 'present' THEN value IS NOT NULL WHEN 'absent' THEN value IS NULL WHEN 'equals' THEN value = expected
  WHEN 'changed' THEN value IS DISTINCT FROM before WHEN 'unchanged' THEN value IS NOT DISTINCT FROM before WHEN 'matches' THEN regexp_matches(value, expected) WHEN 'status_in' THEN list_contains(string_split(expected, ','), value) END THEN 'passed' ELSE 'failed' END AS result
  FROM u m CROSS JOIN (VALUES {_CHECKS}) c(id, op, expected) LEFT JOIN o ON o.user_id = m.user_id AND o.checkpoint_id = c.id)
SELECT user_id AS mission_id, count(*) FILTER (result = 'passed') AS passed, count(*) FILTER (result = 'failed') AS failed, count(*) FILTER (result = 'blocked') AS blocked,
  CASE WHEN failed > 0 THEN 'failed' WHEN blocked > 0 THEN 'blocked' ELSE 'passed' END AS verdict FROM r GROUP BY user_id
""")
def checkpoint_verdicts(spark, d):
    """Each user as a mission with seven checkpoints, and its verdict."""
    e = load(spark, d, "events")
    at = F.struct("ts", "event_id")
    u = e.groupBy(F.col("user_id").alias("mission_id")).agg(
        F.min_by("event_type", at).alias("first"), F.max_by("event_type", at).alias("last"), F.floor(F.sum("value") / 100).cast("bigint").cast("string").alias("spend"), F.count_if(F.col("event_type") == "signup").alias("signups")
    )
    none = F.lit(None).cast("string")
    seen = [("spend", F.col("spend"), none), ("signup", F.when(F.col("signups") > 10, F.col("signups").cast("string")), none), ("first", F.col("first"), none), ("last", F.col("last"), none), ("drift", F.col("last"), F.col("first")), ("move", F.col("last"), F.col("first"))]
    obs = u.select("mission_id", F.explode(F.array(*[F.struct(F.lit(k).alias("checkpoint_id"), v.alias("value"), b.alias("before")) for k, v, b in seen])).alias("o")).select("mission_id", "o.*").where("checkpoint_id <> 'signup' or value is not null")
    rule = F.array(*[F.struct(F.lit(a).alias("checkpoint_id"), F.lit(b).alias("operator"), F.lit(c).alias("expected")) for a, b, c in CHECKS])
    checks = u.select("mission_id", F.explode(rule).alias("c")).select("mission_id", "c.*")
    return op.verdicts(op.checkpoint_results(checks, obs))


@query("""
WITH s AS (SELECT c_custkey, c_acctbal >= -500 AS requested, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'P') AS blockers, count(DISTINCT o_orderkey) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS ambiguities,
  count(DISTINCT o_orderkey) AS expected, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS observed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, CASE WHEN NOT requested THEN 'not_evaluated' WHEN blockers > 3 THEN 'blocked' WHEN ambiguities > 2 THEN 'ambiguous' WHEN expected > 0 AND observed = expected THEN 'observed' WHEN observed > 0 THEN 'partially_observed'
  WHEN expected > 0 THEN 'not_observed' ELSE 'not_evaluated' END AS status FROM s
""")
def coverage_status(spark, d):
    """The six coverage statuses by precedence, over customers and their orders."""
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("b"), F.count_if(F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("a"), F.count("*").alias("e"), F.count_if(F.col("o_orderstatus") == "F").alias("s"))
    c = load(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").fillna(0, ["b", "a", "e", "s"])
    status = op.coverage_status(F.col("c_acctbal") >= -500, F.greatest(F.lit(0), F.col("b") - 3), F.greatest(F.lit(0), F.col("a") - 2), F.col("e"), F.col("s"), F.col("e"))
    return c.select("c_custkey", status.alias("status"))


@query("""
SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_custkey % 3 IS DISTINCT FROM o_orderkey % 3 THEN 'build' END, CASE WHEN o_orderstatus IS DISTINCT FROM 'O' THEN 'graph' END,
  CASE WHEN o_orderpriority IS DISTINCT FROM '1-URGENT' THEN 'source' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM orders
""")
def freshness_reasons(spark, d):
    """Which revisions of each order differ from the current ones."""
    pairs = {"source": (F.col("o_orderpriority"), F.lit("1-URGENT")), "graph": (F.col("o_orderstatus"), F.lit("O")), "build": (F.col("o_custkey") % 3, F.col("o_orderkey") % 3)}
    return load(spark, d, "orders").select("o_orderkey", op.stale_reasons(pairs).alias("reasons"))


#: The policy of the linking query: each clause needs one of its methods.
POLICY = (("F", "origin", "A"), ("F", "origin", "N"), ("F", "return", "R"), ("O", "any", "A"), ("O", "any", "N"), ("O", "any", "R"))


@query(f"""
WITH p(relation, clause, method) AS (VALUES {", ".join(str(x) for x in POLICY)}), m AS (SELECT DISTINCT l_orderkey, l_returnflag AS method FROM lineitem),
short AS (SELECT DISTINCT o_orderkey FROM orders JOIN (SELECT DISTINCT relation, clause FROM p) c ON c.relation = o_orderstatus
  WHERE NOT EXISTS (SELECT 1 FROM m JOIN p ON p.method = m.method WHERE m.l_orderkey = o_orderkey AND p.relation = c.relation AND p.clause = c.clause))
SELECT o_orderkey, o_orderkey NOT IN (SELECT o_orderkey FROM short) AS met FROM orders
""")
def link_policy(spark, d):
    """Whether each order's lines meet its status's policy: every clause by one of its methods."""
    links = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    methods = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("method"))
    return op.policy_met(links, methods, spark.createDataFrame(list(POLICY), "relation string, clause string, method string"), "o_orderkey", "o_orderstatus")


@query("""
SELECT 'customer_without_order' AS kind, c_custkey::VARCHAR AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'order_without_line', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'part_never_returned', p_partkey::VARCHAR FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT DISTINCT 'claim_conflict', l_partkey || '-' || l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_returnflag) = 2
UNION ALL SELECT DISTINCT 'stale_line', l_orderkey::VARCHAR FROM lineitem WHERE l_discount >= 0.1
""")
def coverage_gaps(spark, d):
    """The gap matrix: missing edges, unreached kinds, conflicts and stale links as rows."""
    c, o, li, p = (load(spark, d, t) for t in ("customer", "orders", "lineitem", "part"))
    conflict = li.where("l_returnflag in ('A', 'R')").groupBy("l_partkey", "l_suppkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n = 2").select(F.concat_ws("-", "l_partkey", "l_suppkey"))
    return op.gaps([
        ("customer_without_order", c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")),
        ("order_without_line", o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti").select("o_orderkey")),
        ("part_never_returned", p.join(li.where("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")),
        ("claim_conflict", conflict),
        ("stale_line", li.where("l_discount >= 0.1").select("l_orderkey")),
    ])


@query("""
WITH hit AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2'), acc AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey IN (FROM hit))
SELECT o_orderkey, CASE WHEN o_orderkey IN (FROM hit) THEN CASE WHEN o_orderstatus = 'O' THEN 'invalidated' ELSE 'reassess' END WHEN o_custkey IN (FROM acc) THEN 'reused_near_change' ELSE 'reused' END AS plan FROM orders
""")
def refresh_plan(spark, d):
    """What a change of a brand means for each order: invalidated, to be assessed again, or reused."""
    li, p, o = (load(spark, d, t) for t in ("lineitem", "part", "orders"))
    hit = li.join(p.where("p_brand = 'Brand#2'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("_hit")).distinct()
    x = o.select("o_orderkey", "o_custkey", "o_orderstatus").join(hit, F.col("o_orderkey") == F.col("_hit"), "left")
    near = x.where("_hit is not null").select(F.col("o_custkey").alias("_near")).distinct()
    x = x.join(near, F.col("o_custkey") == F.col("_near"), "left")
    ladder = [(F.col("_hit").isNotNull() & (F.col("o_orderstatus") == "O"), "invalidated"), (F.col("_hit").isNotNull(), "reassess"), (F.col("_near").isNotNull(), "reused_near_change")]
    return x.select("o_orderkey", rows.first_match(ladder, "reused").alias("plan"))


@query("""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations), g AS (SELECT conv_id, count(*) AS steps, count(*) FILTER (role = 'assistant') AS replies, count(*) FILTER (coalesce(text, '') = '') AS empty,
  min(turn) FILTER (role = 'assistant') AS first_reply, min(turn) FILTER (role = 'user') AS first_ask FROM r GROUP BY conv_id)
SELECT conv_id, steps, CASE WHEN steps = 0 THEN 1.0 ELSE round(replies / steps, 6) END AS recall, coalesce(first_ask < first_reply, false) AS in_order, round(1 - empty / steps, 6) AS efficiency FROM g
""")
def trajectory_metrics(spark, d):
    """Per trajectory: required recall, phase order and efficiency."""
    c = load(spark, d, "conversations")
    is_, turn = lambda r: F.col("role") == r, F.col("turn")
    g = c.groupBy("conv_id").agg(F.count("*").alias("steps"), F.count_if(is_("assistant")).alias("_r"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("_e"), F.min(F.when(is_("assistant"), turn)).alias("_fr"), F.min(F.when(is_("user"), turn)).alias("_fa"))
    return g.select("conv_id", "steps", F.round(F.col("_r") / F.col("steps"), 6).alias("recall"), F.coalesce(F.col("_fa") < F.col("_fr"), F.lit(False)).alias("in_order"), F.round(1 - F.col("_e") / F.col("steps"), 6).alias("efficiency"))


_NODES = "SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus <> 'P'"


@query(f"""
WITH n AS ({_NODES}), e AS (SELECT 'e' || l_orderkey || '-' || l_linenumber AS id, 'o' || l_orderkey AS from_id, 'c' || o_custkey AS to_id, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS tier,
  CASE WHEN l_linestatus = 'F' THEN 'accepted' ELSE 'pending' END AS review_state FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
v AS (SELECT 'duplicate_node' AS code, id FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'duplicate_edge', id FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'missing_from', from_id FROM e WHERE from_id NOT IN (SELECT id FROM n)
  UNION ALL SELECT 'missing_to', to_id FROM e WHERE to_id NOT IN (SELECT id FROM n) UNION ALL SELECT 'unreviewed_tier', id FROM e WHERE tier = 'C' AND review_state <> 'accepted')
SELECT code, count(*) AS n, count(DISTINCT id) AS ids FROM v GROUP BY code
""")
def publication_validation(spark, d):
    """Why a revision of orders and customers may not be published, counted by rule."""
    o, li, c = (load(spark, d, t) for t in ("orders", "lineitem", "customer"))
    n = c.select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(o.where("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), "o_orderkey")))
    tier = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")
    tasks = rows.tasks_for(li, o, c)
    li = li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").repartition(tasks, "l_orderkey")
    own = o.select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey").hint("shuffle_hash")
    e = li.join(own, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("e"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("id"), F.concat(F.lit("o"), "l_orderkey").alias("from_id"), F.concat(F.lit("c"), "o_custkey").alias("to_id"), tier.alias("tier"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("pending").alias("review_state")
    )
    v = publish.violations(n, cut(e, "edges")).repartition(tasks, "code", "id").groupBy("code", "id").count()  # the checks read edges, and join once
    return v.groupBy("code").agg(F.sum("count").alias("n"), F.count("*").alias("ids"))


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag = 'R' AND l_linestatus = 'O' AS unreviewed, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1 AS competing FROM lineitem
QUALIFY unreviewed OR competing
""")
def review_candidates(spark, d):
    """Edges a person should look at: weak and unreviewed, or with a competitor between the same ends."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    n = li.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("_n"))
    x = li.join(n, ["l_orderkey", "l_suppkey"]).withColumn("unreviewed", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).withColumn("competing", F.col("_n") > 1)
    return x.where("unreviewed or competing").select("l_orderkey", "l_linenumber", "l_suppkey", "unreviewed", "competing")
