"""Queries over missions, verification, coverage, budgets and event feeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import missions as op
from strandline.plans.registry import load, query

_RISK = "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'low' ELSE 'unknown' END"


@query(f"""
WITH s AS (SELECT o_custkey AS scenario_id, o_orderkey AS finding_id, {_RISK} AS risk, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS workflow_id FROM orders JOIN customer ON c_custkey = o_custkey),
g AS (SELECT scenario_id, min(CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS p, max(workflow_id) AS workflow_id, count(DISTINCT finding_id) AS findings FROM s WHERE risk <> 'unknown' GROUP BY 1),
a AS (SELECT scenario_id AS id, p, findings FROM g WHERE workflow_id IS NOT NULL AND scenario_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) ORDER BY p, scenario_id LIMIT 10),
c AS (SELECT min(s_suppkey) AS id FROM supplier WHERE s_nationkey + 20 NOT IN (SELECT workflow_id FROM s WHERE risk <> 'unknown' AND workflow_id IS NOT NULL)),
u AS (SELECT 'affected' AS kind, id, p, findings FROM a UNION ALL SELECT 'control', id, 2, 0 FROM c WHERE id IS NOT NULL)
SELECT kind, (row_number() OVER (ORDER BY kind, p, id) - 1)::INTEGER AS ordinal, id, ['high', 'medium', 'low'][p + 1] AS priority, findings FROM u
""")
def verification_plan(spark, d):
    """The missions of a verification plan: at most ten affected scenarios by priority, and one control (a plan's limit)."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    p = F.col("o_orderpriority")
    risk = F.when(p == "1-URGENT", "high").when(p == "2-HIGH", "medium").when(p == "3-MEDIUM", "low").otherwise("unknown")
    s = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    s = s.select(F.col("o_orderkey").alias("finding_id"), risk.alias("risk"), F.col("o_custkey").alias("scenario_id"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("workflow_id"))
    known = o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("scenario_id"))
    controls = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 20).alias("workflow_id"))
    return op.plan(s, known, controls, 10)


@query("""
WITH r AS (SELECT o_custkey AS run_id, o_orderkey AS mission_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'followup' ELSE 'affected' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'blocked' ELSE 'failed' END AS status FROM orders),
a AS (SELECT l_orderkey AS mission_id, l_suppkey % 10 AS checkpoint_id, CASE WHEN l_linestatus = 'F' THEN 'passed' ELSE 'blocked' END AS outcome FROM lineitem),
k AS (SELECT DISTINCT run_id, checkpoint_id FROM r JOIN a USING (mission_id) WHERE kind = 'followup' AND status = 'passed' AND outcome = 'passed'),
b AS (SELECT run_id, mission_id, checkpoint_id FROM r JOIN a USING (mission_id) WHERE kind <> 'followup' AND status = 'blocked' AND outcome = 'blocked'),
g AS (SELECT mission_id FROM b LEFT JOIN k ON k.run_id = b.run_id AND k.checkpoint_id = b.checkpoint_id GROUP BY 1 HAVING count(*) = count(k.run_id))
SELECT mission_id, status FROM r WHERE mission_id NOT IN (FROM g)
""")
def effective_results(spark, d):
    """Results without the blocked missions whose checkpoints a follow-up passed."""
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    kind, s = F.when(F.col("o_orderpriority") == "5-LOW", "followup").otherwise("affected"), F.col("o_orderstatus")
    r = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("mission_id"), kind.alias("kind"), F.when(s == "F", "passed").when(s == "O", "blocked").otherwise("failed").alias("status"), F.lit("agent_block").alias("category"))
    a = li.select(F.col("l_orderkey").alias("mission_id"), (F.col("l_suppkey") % 10).alias("checkpoint_id"), F.when(F.col("l_linestatus") == "F", "passed").otherwise("blocked").alias("outcome"))
    return op.effective_results(r, a).select("mission_id", "status")


@query("""
WITH a AS (SELECT o_orderkey AS artifact_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'report' ELSE 'run' END AS purpose, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'blocked' END AS status FROM orders),
k AS (SELECT *, status IN ('failed', 'blocked') AS f FROM a)
SELECT artifact_id, CASE WHEN f OR purpose = 'report' THEN 'retain' ELSE 'delete' END AS disposition, CASE WHEN f THEN 'failure_evidence' WHEN purpose = 'report' THEN 'report_evidence' ELSE 'successful_run' END AS reason,
  CASE WHEN f THEN TIMESTAMP '1998-01-31' WHEN purpose = 'report' THEN TIMESTAMP '1998-01-08' END AS delete_after FROM k
""")
def artifact_retention(spark, d):
    """What stays of a run's artifacts, why, and until when."""
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "passed").when(s == "O", "failed").otherwise("blocked")
    a = load(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "report").otherwise("run").alias("purpose"), status.alias("status"))
    return op.retention(a, F.lit("1998-01-01 00:00:00").cast("timestamp"), 30 * 86400, 7 * 86400, 0)


@query("""
WITH c AS (SELECT l_orderkey AS k, max(l_shipdate) AS u FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, greatest(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, u) AS retain_until FROM orders LEFT JOIN c ON k = o_orderkey
""")
def retention_updates(spark, d):
    """Retention dates that only grow, from none too."""
    o = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("retain_until"))
    c = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("retain_until"))
    return op.keep_until(o, c, "o_orderkey", "retain_until")


@query("""
WITH e AS (SELECT l_suppkey, l_partkey, max_by((l_quantity, l_tax), (l_shipdate, l_orderkey, l_linenumber, l_quantity, l_tax)) AS r FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS entries, sum(struct_extract(r, 1)) AS l_quantity, round(sum(struct_extract(r, 2)), 6) AS l_tax FROM e GROUP BY 1
""")
def budget_ledger(spark, d):
    """Sums of the last version of each entry of a ledger."""
    x = op.ledger(load(spark, d, "lineitem"), "l_suppkey", "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_tax"], ["l_quantity", "l_tax"])
    return x.withColumn("l_tax", F.round("l_tax", 6))


@query("SELECT l_orderkey, l_linenumber, count(*) AS versions, count(DISTINCT (l_partkey, l_suppkey)) > 1 AS conflict FROM lineitem GROUP BY 1, 2")
def reducer_conflicts(spark, d):
    """Keys whose rows differ: equal ones merge, others are a conflict."""
    return op.reduce_by_key(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.struct("l_partkey", "l_suppkey"))


@query("""
WITH c AS (SELECT user_id, event_id, CASE WHEN row_number() OVER w = 1 THEN NULL WHEN value > 99 THEN -1 ELSE lag(event_id) OVER w END AS cursor, CASE WHEN lead(event_id) OVER w IS NOT NULL OR value > 99.5 THEN event_id END AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT *, row_number() OVER w = 1 AS first, lag(nxt) OVER w AS before, lead(event_id) OVER w IS NULL AS last FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, bool_and(CASE WHEN first THEN cursor IS NULL ELSE coalesce(cursor = before, false) END AND (NOT last OR nxt IS NULL)) AND count(cursor) = count(DISTINCT cursor) AS complete FROM k GROUP BY 1
""")
def root_traversals(spark, d):
    """Whether a user's pages were read to the end, each from where the one before stopped."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    v, n = F.col("value"), F.col("event_id")
    cursor = F.when(F.row_number().over(w) > 1, F.when(v > 99, F.lit(-1).cast("bigint")).otherwise(F.lag(n).over(w)))
    nxt = F.when(F.lead(n).over(w).isNotNull() | (v > 99.5), n)
    e = load(spark, d, "events").select("user_id", "event_id", cursor.alias("cursor"), nxt.alias("nxt"))
    return op.complete_traversal(e, "user_id", "event_id", "cursor", "nxt")


@query("""
WITH j AS (SELECT *, event_type = 'error' AS back, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS journey FROM events)
SELECT user_id, journey, count(*) AS steps, min(event_id) AS first, count(DISTINCT event_type) AS screens FROM j WHERE NOT back GROUP BY 1, 2
""")
def journey_claims(spark, d):
    """Journeys of users, cut where they step back, with their steps and screens."""
    j = op.journeys(load(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return j.groupBy("user_id", "journey").agg(F.count("*").alias("steps"), F.min("event_id").alias("first"), F.count_distinct("event_type").alias("screens"))


@query("""
WITH r AS (SELECT o_orderkey // 2 AS id, o_custkey AS k, o_orderdate AS u, o_orderkey FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) > 1 AS again FROM r),
n AS (SELECT *, max(u) OVER (PARTITION BY k, again ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a), t AS (SELECT k, max_by(id, (u, o_orderkey)) AS top FROM a WHERE NOT again GROUP BY k)
SELECT id, CASE WHEN again THEN 'duplicate' WHEN newest > u THEN 'stale' ELSE 'new' END AS outcome, NOT again AND id = top AS is_current FROM n JOIN t USING (k)
""")
def delivery_outcomes(spark, d):
    """Deliveries in order of arrival: new, stale (a newer state came before) or duplicate, and which is current."""
    r = load(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("id"), F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("u"), "o_orderkey")
    return op.deliveries(r, "id", "k", "u", ["o_orderkey"])


@query("""
WITH RECURSIVE n AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 9 ELSE least(o_orderkey % 4 + 1, 3) END::INTEGER AS version, o_orderstatus AS payload, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), f AS MATERIALIZED (FROM n),
w AS (SELECT *, CASE WHEN version = 1 THEN [payload] ELSE []::VARCHAR[] END AS there, CASE WHEN version = 1 THEN 'appended' ELSE 'gap' END AS outcome FROM f WHERE k = 1 UNION ALL
  SELECT f.*, CASE WHEN f.version = len(there) + 1 THEN list_append(there, f.payload) ELSE there END,
    CASE WHEN f.version = len(there) + 1 THEN 'appended' WHEN f.version <= len(there) THEN CASE WHEN there[f.version] = f.payload THEN 'repeated' ELSE 'conflict' END ELSE 'gap' END FROM w JOIN f ON f.o_custkey = w.o_custkey AND f.k = w.k + 1)
SELECT o_custkey, o_orderkey, version, payload, outcome FROM w
""")
def report_versions(spark, d):
    """Versions appended to reports: the next one, a repeat, a conflict or a gap."""
    version = F.when(F.col("o_orderpriority") == "5-LOW", 9).otherwise(F.least(F.col("o_orderkey") % 4 + 1, F.lit(3))).cast("int")
    a = load(spark, d, "orders").select("o_custkey", "o_orderkey", version.alias("version"), F.col("o_orderstatus").alias("payload"))
    return op.accept_versions(a, "o_custkey", ["o_orderkey"], "version", "payload")


@query("""
SELECT user_id, CASE event_type WHEN 'error' THEN 'problems' WHEN 'purchase' THEN 'results' ELSE 'browsing' END AS lane, count(*) AS events, max_by(event_type, (ts, event_id)) AS status, round(sum(value), 4) AS spent FROM events GROUP BY 1, 2
""")
def activity_lanes(spark, d):
    """Lanes of each user's activity feed with their newest status and cost."""
    t = F.col("event_type")
    lane = F.when(t == "error", "problems").when(t == "purchase", "results").otherwise("browsing")
    x = op.feed(load(spark, d, "events"), "user_id", lane, ["ts", "event_id"], "event_type", "value")
    return x.withColumn("spent", F.round("spent", 4))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'action_observed' WHEN 'view' THEN 'state_observed' WHEN 'purchase' THEN 'mission_finished' WHEN 'signup' THEN 'mission_started' ELSE 'mission_failed' END AS kind,
  TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS target, CASE WHEN event_type = 'error' THEN 'agent_error' END AS reason_code, event_type IN ('purchase', 'error') AS terminal FROM events
""")
def typed_events(spark, d):
    """Emissions as typed events."""
    t = F.col("event_type")
    kind = F.when(t == "click", "action_observed").when(t == "view", "state_observed").when(t == "purchase", "mission_finished").when(t == "signup", "mission_started").otherwise("mission_failed")
    target = F.get_json_object("props", "$.k").try_cast("bigint")
    return load(spark, d, "events").select("event_id", kind.alias("kind"), target.alias("target"), F.when(t == "error", "agent_error").alias("reason_code"), t.isin("purchase", "error").alias("terminal"))


@query("""
SELECT user_id, count(*) AS runs, max(ts) AS last_seen, max_by(event_type, (ts, event_id)) AS last_status, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id
""")
def application_summaries(spark, d):
    """A summary by user, as the view over runs gives it."""
    e = load(spark, d, "events").groupBy("user_id")
    return e.agg(F.count("*").alias("runs"), F.max("ts").alias("last_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"), F.count_if(F.col("event_type") == "error").alias("failures"))


@query("""
WITH w AS (SELECT o_custkey AS r, count(*) AS workflows, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1), s AS (SELECT o_custkey AS r, count(DISTINCT l_partkey) AS symbols, count(*) FILTER (l_returnflag = 'R') AS tests FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey AS requirement_id, coalesce(workflows, 0) AS workflows, coalesce(symbols, 0) AS symbols, coalesce(tests, 0) AS tests,
  CASE WHEN coalesce(workflows, 0) = 0 THEN 'missing' WHEN coalesce(symbols, 0) = 0 THEN 'partial' WHEN done = workflows AND tests > 0 THEN 'verified' WHEN tests > 0 THEN 'covered' ELSE 'untested' END AS status FROM customer LEFT JOIN w ON w.r = c_custkey LEFT JOIN s ON s.r = c_custkey
""")
def coverage_matrix(spark, d):
    """The matrix of requirements: workflows, symbols and tests of each, and its status."""
    return _matrix(spark, d)


def _matrix(spark, d):
    o, li = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    w = o.groupBy(F.col("o_custkey").alias("r")).agg(F.count("*").alias("workflows"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    s = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("r"), "l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("t"))
    s = s.groupBy("r").agg(F.count("*").alias("symbols"), F.sum("t").alias("tests"))
    x = load(spark, d, "customer").select(F.col("c_custkey").alias("r")).join(w, "r", "left").join(s, "r", "left").na.fill(0)
    status = (
        F.when(F.col("workflows") == 0, "missing").when(F.col("symbols") == 0, "partial").when((F.col("done") == F.col("workflows")) & (F.col("tests") > 0), "verified")
        .when(F.col("tests") > 0, "covered").otherwise("untested")
    )
    return x.select(F.col("r").alias("requirement_id"), "workflows", "symbols", "tests", status.alias("status"))


@query("""
WITH w AS (SELECT o_custkey AS r, count(*) AS workflows, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1), s AS (SELECT o_custkey AS r, count(DISTINCT l_partkey) AS symbols, count(*) FILTER (l_returnflag = 'R') AS tests FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
m AS (SELECT CASE WHEN coalesce(workflows, 0) = 0 THEN 'missing' WHEN coalesce(symbols, 0) = 0 THEN 'partial' WHEN done = workflows AND tests > 0 THEN 'verified' WHEN tests > 0 THEN 'covered' ELSE 'untested' END AS status FROM customer LEFT JOIN w ON w.r = c_custkey LEFT JOIN s ON s.r = c_custkey)
SELECT count(*) AS requirements, count(*) FILTER (status IN ('verified', 'covered')) AS covered, count(*) FILTER (status = 'missing') AS missing, round(count(*) FILTER (status IN ('verified', 'covered')) / count(*), 6) AS share,
  CASE WHEN count(*) FILTER (status = 'missing') > 0 THEN 'not_ready' WHEN count(*) FILTER (status IN ('partial', 'untested')) > 0 THEN 'partly_ready' ELSE 'ready' END AS readiness FROM m
""")
def coverage_readiness(spark, d):
    """The matrix in one row: counts, the share covered and the readiness."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    x = _matrix(spark, d).agg(F.count("*").alias("requirements"), n("verified", "covered").alias("covered"), n("missing").alias("missing"), n("partial", "untested").alias("_open"))
    ready = F.when(F.col("missing") > 0, "not_ready").when(F.col("_open") > 0, "partly_ready").otherwise("ready")
    return x.select("requirements", "covered", "missing", F.round(F.col("covered") / F.col("requirements"), 6).alias("share"), ready.alias("readiness"))


@query("""
WITH b AS (SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5) SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM b
""")
def topk_by_id(spark, d):
    """The five best candidates of each brand by score, then in order of their ids (a top-k report)."""
    w = lambda *c: F.row_number().over(Window.partitionBy("p_brand").orderBy(*c))
    best = load(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice").withColumn("_k", w(F.desc("p_retailprice"), "p_partkey")).where("_k <= 5")
    return best.select("p_brand", "p_partkey", w("p_partkey").cast("bigint").alias("place"))


@query("""
SELECT o_custkey, count(*) AS files, count(*) FILTER (o_orderstatus <> 'P') AS mapped, count(*) FILTER (o_orderstatus = 'P') AS unmapped, count(*) FILTER (o_orderpriority = '5-LOW') AS generated FROM orders GROUP BY 1
""")
def diff_summary(spark, d):
    """Mapped and unmapped files of each change."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    g = load(spark, d, "orders").groupBy("o_custkey")
    return g.agg(F.count("*").alias("files"), F.count_if(s != "P").alias("mapped"), F.count_if(s == "P").alias("unmapped"), F.count_if(p == "5-LOW").alias("generated"))


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS operation, CASE WHEN l_discount > 0.02 THEN 'old' END AS old_path, CASE WHEN l_tax > 0.01 THEN 'new' END AS new_path FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN operation = 'added' AND old_path IS NOT NULL THEN 'added_with_base' WHEN operation = 'deleted' AND new_path IS NOT NULL THEN 'deleted_with_head' WHEN operation = 'modified' AND (old_path IS NULL OR new_path IS NULL) THEN 'modified_without_side' END AS code
FROM f WHERE code IS NOT NULL
""")
def diff_invariants(spark, d):
    """Changed files that break a rule of their operation."""
    f = F.col("l_returnflag")
    operation = F.when(f == "A", "added").when(f == "R", "deleted").otherwise("modified")
    x = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", operation.alias("operation"), F.when(F.col("l_discount") > 0.02, "old").alias("old_path"), F.when(F.col("l_tax") > 0.01, "new").alias("new_path"))
    old, new = F.col("old_path").isNotNull(), F.col("new_path").isNotNull()
    code = F.when((F.col("operation") == "added") & old, "added_with_base").when((F.col("operation") == "deleted") & new, "deleted_with_head").when((F.col("operation") == "modified") & ~(old & new), "modified_without_side")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", code.alias("code")).where("code is not null")


@query("""
WITH c AS (SELECT doc_id, CASE WHEN lang IN ('de', 'en') THEN 'development' ELSE 'held_out' END AS split, sha256(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) AS f FROM documents),
g AS (SELECT f, count(DISTINCT split) AS splits FROM c GROUP BY f)
SELECT split, count(*) AS cases, count(*) FILTER (splits > 1) AS leaked, count(DISTINCT f) AS fingerprints FROM c JOIN g USING (f) GROUP BY split
""")
def split_leakage(spark, d):
    """Cases of each split, and those whose fingerprint stands in the other split too."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
    split = F.when(F.col("lang").isin("de", "en"), "development").otherwise("held_out")
    c = load(spark, d, "documents").select(split.alias("split"), F.sha2(norm.cast("binary"), 256).alias("f")).groupBy("split", "f").agg(F.count("*").alias("n"))
    g = c.groupBy("f").agg(F.count("*").alias("splits"))
    return c.join(g, "f").groupBy("split").agg(F.sum("n").alias("cases"), F.coalesce(F.sum(F.when(F.col("splits") > 1, F.col("n"))), F.lit(0)).alias("leaked"), F.count("*").alias("fingerprints"))


@query("""
WITH f AS (SELECT o_orderkey, ['added', 'removed', 'modified', 'renamed', 'copied', 'changed', 'unchanged'][o_orderkey % 7 + 1] AS status, o_orderpriority = '5-LOW' AS no_patch, o_totalprice > 400000 AS is_binary FROM orders)
SELECT o_orderkey, CASE status WHEN 'removed' THEN 'deleted' WHEN 'copied' THEN 'added' WHEN 'changed' THEN 'modified' WHEN 'unchanged' THEN NULL ELSE status END AS operation, status = 'copied' AS copied, NOT no_patch AND NOT is_binary AS patch_available,
  CASE WHEN status <> 'added' AND status <> 'copied' THEN 'src/old' || o_orderkey END AS old_path, CASE WHEN status <> 'removed' THEN 'src/new' || o_orderkey END AS new_path FROM f
""")
def pull_files(spark, d):
    """Files of pull requests as the hosting service lists them, in the terms of a diff."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("added", "removed", "modified", "renamed", "copied", "changed", "unchanged")]), (k % 7 + 1).cast("int"))
    x = load(spark, d, "orders").select("o_orderkey", status.alias("s"), (F.col("o_orderpriority") == "5-LOW").alias("no_patch"), (F.col("o_totalprice") > 400000).alias("binary"))
    s = F.col("s")
    operation = F.when(s == "removed", "deleted").when(s == "copied", "added").when(s == "changed", "modified").otherwise(s)
    return x.select(
        "o_orderkey", F.when(s != "unchanged", operation).alias("operation"), (s == "copied").alias("copied"), (~F.col("no_patch") & ~F.col("binary")).alias("patch_available"),
        F.when(~s.isin("added", "copied"), F.concat(F.lit("src/old"), k)).alias("old_path"), F.when(s != "removed", F.concat(F.lit("src/new"), k)).alias("new_path"),
    )


@query("""
SELECT user_id, count(DISTINCT CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') END) AS pages, count(*) FILTER (event_type = 'click') AS searches, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type = 'view' AND value > 50) AS stable_visits FROM events GROUP BY user_id
""")
def mission_metrics(spark, d):
    """Distinct pages, calls by tool and visits of a state, by mission."""
    is_ = lambda t: F.col("event_type") == t
    g = load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).groupBy("user_id")
    return g.agg(F.count_distinct(F.when(is_("view"), F.col("k"))).alias("pages"), F.count_if(is_("click")).alias("searches"), F.count_if(is_("view")).alias("reads"), F.count_if(is_("view") & (F.col("value") > 50)).alias("stable_visits"))


@query("""
WITH t AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS t FROM part), n AS (SELECT p_partkey, CASE WHEN length(t) > 3 AND t LIKE '%s' THEN left(t, -1) ELSE t END AS term FROM t)
SELECT term, count(*) AS statements, min(p_partkey) AS first, array_to_string(list_sort(list(p_partkey))[1:10], ',') AS ids FROM n GROUP BY term
""")
def capability_terms(spark, d):
    """Statements by their normalised capability, with their first ten ids (a bounded slice)."""
    x = load(spark, d, "part").select("p_partkey", tx.term(F.col("p_name")).alias("term"))
    few = x.withColumn("_k", F.row_number().over(Window.partitionBy("term").orderBy("p_partkey")))
    g = few.groupBy("term").agg(F.count("*").alias("statements"), F.min("p_partkey").alias("first"), F.array_sort(F.collect_list(F.when(F.col("_k") <= 10, F.col("p_partkey")))).alias("ids"))
    return g.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, lead(event_id) OVER w AS nxt, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT 'u' || user_id AS from_id, 'HAS_STEP' AS type, 'e' || event_id AS to_id FROM e UNION ALL SELECT 'e' || event_id, 'ON_SCREEN', event_type FROM e UNION ALL SELECT 'e' || event_id, 'NEXT', 'e' || nxt FROM e WHERE nxt IS NOT NULL
UNION ALL SELECT DISTINCT event_type, 'CONTAINS', 'k' || k FROM e WHERE k IS NOT NULL
""")
def application_claims(spark, d):
    """Edges that claims give: steps, screens, successors and elements."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", F.lead("event_id").over(w).alias("nxt"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda d, a, t, b: d.select(a.alias("from_id"), F.lit(t).alias("type"), b.alias("to_id"))
    out = edge(e, named("u", "user_id"), "HAS_STEP", named("e", "event_id")).union(edge(e, named("e", "event_id"), "ON_SCREEN", F.col("event_type")))
    out = out.union(edge(e.where("nxt is not null"), named("e", "event_id"), "NEXT", named("e", "nxt")))
    return out.union(edge(e.where("k is not null"), F.col("event_type"), "CONTAINS", named("k", "k")).distinct())


@query("""
WITH u AS (SELECT l_partkey AS symbol, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'added' ELSE 'modified' END AS op, 0 AS side FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'deleted' ELSE 'modified' END, 1 FROM lineitem WHERE l_returnflag <> 'A')
SELECT symbol, max_by(op, (l_orderkey, l_linenumber, side)) AS operation FROM u GROUP BY symbol
""")
def symbol_operations(spark, d):
    """The last operation on each symbol, over base and head sides of changes."""
    f = F.col("l_returnflag")
    base = F.when(f != "R", F.struct(F.lit(0).alias("side"), F.when(f == "A", "added").otherwise("modified").alias("op")))
    head = F.when(f != "A", F.struct(F.lit(1).alias("side"), F.when(f == "R", "deleted").otherwise("modified").alias("op")))
    x = load(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), "l_orderkey", "l_linenumber", F.explode(F.array_compact(F.array(base, head))).alias("s"))
    return x.groupBy("symbol").agg(F.max_by("s.op", F.struct("l_orderkey", "l_linenumber", "s.side")).alias("operation"))


@query("""
WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders), t AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'exact' WHEN o_orderpriority = '5-LOW' THEN 'unrelated' WHEN l_orderkey IS NULL THEN 'safe_ancestor' ELSE 'stale_relevant' END AS baseline FROM b LEFT JOIN t ON l_orderkey = o_orderkey
""")
def baseline_compatibility(spark, d):
    """Whether a baseline serves a change: equal, an ancestor without changes to indexed paths, a stale one, or unrelated."""
    small = load(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    touched = load(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(small, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_t", F.lit(True))
    b = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(touched, "o_orderkey", "left")
    code = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderpriority") == "5-LOW", "unrelated").when(F.col("_t").isNull(), "safe_ancestor").otherwise("stale_relevant")
    return b.select("o_orderkey", code.alias("baseline"))


@query("""
WITH r AS (SELECT DISTINCT l_partkey, l_returnflag, l_orderkey FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey) AS k, count(*) OVER (PARTITION BY l_partkey, l_returnflag) AS refs FROM r)
SELECT l_partkey, l_returnflag, refs, array_to_string(list(l_orderkey ORDER BY l_orderkey), ',') AS first_refs FROM k WHERE k <= 10 GROUP BY ALL
""")
def report_references(spark, d):
    """References merged by entity and method, with the first ten of each (a report's bound) and how many there are."""
    r = load(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey").distinct()
    g = Window.partitionBy("l_partkey", "l_returnflag")
    k = r.withColumn("_k", F.row_number().over(g.orderBy("l_orderkey"))).withColumn("refs", F.count("*").over(g)).where("_k <= 10")
    x = k.groupBy("l_partkey", "l_returnflag", "refs").agg(F.array_sort(F.collect_list("l_orderkey")).alias("a"))
    return x.select("l_partkey", "l_returnflag", "refs", F.array_join(F.col("a").cast("array<string>"), ",").alias("first_refs"))


@query("""
WITH n AS (SELECT lower(p_name) AS n, min(p_partkey) AS id FROM part GROUP BY 1), r AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'shiny' WHEN 2 THEN 'hot' ELSE 'none' END AS cls, CASE s_suppkey % 3 WHEN 0 THEN 'bolt' WHEN 1 THEN 'gear' ELSE 'x' END AS method FROM supplier)
SELECT s_suppkey, coalesce(a.id, b.id) AS target, CASE WHEN a.id IS NOT NULL THEN 'method' WHEN b.id IS NOT NULL THEN 'invokable' ELSE 'unresolved' END AS outcome FROM r LEFT JOIN n a ON a.n = cls || ' ' || method LEFT JOIN n b ON b.n = cls || ' widget'
""")
def route_actions(spark, d):
    """Route actions resolved to a class's method, else to the class as a callable, else not at all."""
    n = load(spark, d, "part").groupBy(F.lower("p_name").alias("n")).agg(F.min("p_partkey").alias("id"))
    k = F.col("s_suppkey")
    cls = F.when(k % 4 == 0, "red").when(k % 4 == 1, "shiny").when(k % 4 == 2, "hot").otherwise("none")
    method = F.when(k % 3 == 0, "bolt").when(k % 3 == 1, "gear").otherwise("x")
    r = load(spark, d, "supplier").select("s_suppkey", F.concat(cls, F.lit(" "), method).alias("_a"), F.concat(cls, F.lit(" widget")).alias("_b"))
    x = r.join(n.select(F.col("n").alias("_a"), F.col("id").alias("a")), "_a", "left").join(n.select(F.col("n").alias("_b"), F.col("id").alias("b")), "_b", "left")
    return x.select("s_suppkey", F.coalesce("a", "b").alias("target"), F.when(F.col("a").isNotNull(), "method").when(F.col("b").isNotNull(), "invokable").otherwise("unresolved").alias("outcome"))


@query("""
WITH e AS (SELECT l_partkey, l_returnflag AS method, l_suppkey, l_linestatus FROM lineitem)
SELECT l_partkey, method, count(*) AS evidence, count(DISTINCT l_suppkey) AS handlers, count(*) FILTER (l_linestatus = 'O') AS unresolved, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'ambiguous' ELSE 'single' END AS outcome FROM e GROUP BY 1, 2
""")
def endpoint_handlers(spark, d):
    """Handlers of each endpoint, with what stayed unresolved."""
    g = load(spark, d, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("method"))
    x = g.agg(F.count("*").alias("evidence"), F.count_distinct("l_suppkey").alias("handlers"), F.count_if(F.col("l_linestatus") == "O").alias("unresolved"))
    return x.withColumn("outcome", F.when(F.col("handlers") > 1, "ambiguous").otherwise("single"))
