"""Queries over keyed state and name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import resolution as op
from strandline.plans.registry import load, query


@query("""
WITH e AS (SELECT c_custkey AS id, c_mktsegment AS v, 1 AS version FROM customer), i AS (SELECT o_custkey AS id, o_orderstatus AS v, (o_orderkey % 3)::INTEGER AS version, o_orderkey FROM orders),
u AS (SELECT id, v, version, 0 AS fresh, 0::BIGINT AS k FROM e UNION ALL SELECT id, v, version, 1, o_orderkey FROM i)
SELECT id, v, version, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, k DESC, fresh DESC) AS rn FROM u) WHERE rn = 1
""")
def upsert_latest(spark, d):
    """Customers overwritten by newer rows."""
    e = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"), F.lit(1).alias("version"), F.lit(0).cast("bigint").alias("k"))
    i = load(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("v"), (F.col("o_orderkey") % 3).cast("int").alias("version"), F.col("o_orderkey").alias("k"))
    return op.upsert(e, i, ["id"], ["version", "k"])


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id")
def insert_missing(spark, d):
    """The first event of users that are not known yet."""
    known = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return op.insert_missing(known, load(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_nationkey = o_orderkey % 25 THEN 'replaced' ELSE 'conflict' END AS outcome FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def optimistic_replace(spark, d):
    """Changes that expect a revision: replaced, conflict or missing."""
    c = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("revision"))
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 25).alias("revision"))
    return op.replace_if_revision(c, o, "c_custkey", "revision", ["o_orderkey"])


@query("""
WITH x AS (SELECT p_partkey, p_size::BIGINT AS refs, coalesce((SELECT sum(CASE WHEN l_returnflag = 'R' THEN -2 ELSE 1 END) FROM lineitem WHERE l_partkey = p_partkey), 0)::BIGINT AS delta FROM part)
SELECT p_partkey, CASE WHEN refs + delta >= 0 THEN refs + delta ELSE refs END AS refs, refs + delta < 0 AS rejected FROM x
""")
def reference_counts(spark, d):
    """Reference counts after summed changes, never below zero."""
    p = load(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("refs"))
    deltas = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_returnflag") == "R", -2).otherwise(1).alias("delta"))
    return op.apply_deltas(p, deltas, "p_partkey", "refs")


@query("""
WITH c AS (SELECT page_id, url FROM pages), b AS (SELECT url FROM c WHERE url LIKE 'http://%'), s AS (SELECT DISTINCT url FROM c) SELECT url FROM s WHERE url NOT IN (FROM b) ORDER BY url LIMIT 60
""")
def seed_selection(spark, d):
    """The first sixty addresses of roots and sitemap that no rule blocks (a crawl's page limit)."""
    p = load(spark, d, "pages").select("page_id", "url")
    return op.seed_pages(p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1"), spark.createDataFrame([("http://",)], "prefix string"), 60)


@query("""
SELECT conv_id, turn, used::BIGINT AS used FROM (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM
  (SELECT conv_id, turn, max(length(coalesce(text, ''))) AS n FROM conversations GROUP BY conv_id, turn)) WHERE used <= 1500
""")
def budget_cutoff(spark, d):
    """The turns of each conversation that fit into a budget of characters."""
    c = load(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("n"))
    return op.within_budget(c, ["conv_id"], ["turn"], F.col("n"), 1500).select("conv_id", "turn", "used")


@query("""
WITH n AS (SELECT lower(p_name) AS n, max(p_partkey) AS target FROM part GROUP BY 1), r AS (SELECT s_suppkey, ['Shiny Bolt ' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'RED ' ELSE 'no ' END || 'Widget', CASE WHEN s_suppkey % 3 = 0 THEN 'blue bolt' ELSE 'none' END] AS t FROM supplier),
h AS (SELECT s_suppkey, i - 1 AS rank, target FROM r, unnest(range(1, 4)) u(i) JOIN n ON n.n = lower(t[i])), b AS (SELECT s_suppkey, min(rank) AS rank, min_by(target, rank) AS target FROM h GROUP BY s_suppkey)
SELECT s_suppkey, rank::INTEGER AS rank, target FROM supplier LEFT JOIN b USING (s_suppkey)
""")
def action_fallback(spark, d):
    """Names resolved by the first of three forms that exists, ignoring case."""
    s = load(spark, d, "supplier").select("s_suppkey")
    tries = [F.concat(F.lit("Shiny Bolt "), "s_suppkey"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "RED ").otherwise("no "), F.lit("Widget")), F.when(F.col("s_suppkey") % 3 == 0, "blue bolt").otherwise("none")]
    names = load(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("target"))
    return op.resolve_by_fallback(s, names, "s_suppkey", tries)


@query("""
WITH RECURSIVE c AS (SELECT 'Class' || p_partkey AS name, CASE WHEN p_partkey % 40 = 0 THEN 'Base' ELSE 'CLASS' || (p_partkey // 3) END AS parent FROM part),
w(name) AS (SELECT name FROM c WHERE lower(parent) = 'base' UNION SELECT c.name FROM w JOIN c ON lower(c.parent) = lower(w.name)) SELECT name FROM w
""")
def inherits_from(spark, d):
    """Classes that extend a base class over any number of steps; a cycle is met once."""
    c = load(spark, d, "part").select(F.concat(F.lit("Class"), "p_partkey").alias("name"), F.when(F.col("p_partkey") % 40 == 0, "Base").otherwise(F.concat(F.lit("CLASS"), F.floor(F.col("p_partkey") / 3))).alias("parent"))
    return op.inherits(c, "base")


@query("""
WITH RECURSIVE r AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 4 THEN p_partkey // 4 END AS parent, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 's' || p_partkey END AS segment, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS layout FROM part),
w(id, pattern, layouts) AS (SELECT id, '/' || segment, coalesce(layout, '') FROM r WHERE parent IS NULL
  UNION ALL SELECT r.id, regexp_replace(w.pattern, '/$', '') || '/' || r.segment, CASE WHEN layout IS NULL THEN w.layouts WHEN w.layouts = '' THEN layout ELSE w.layouts || ',' || layout END FROM w JOIN r ON r.parent = w.id)
SELECT id, pattern, layouts FROM w
""")
def route_patterns(spark, d):
    """Route patterns composed down a tree, with the layouts of all ancestors."""
    r = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 4, F.floor(F.col("p_partkey") / 4)).alias("parent"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("s"), "p_partkey")).alias("segment"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("layout"))
    return op.route_tree(r).withColumn("layouts", F.array_join("layouts", ","))


#: The observed routes of the best-match query.
ROUTES = ("/en/:id", "/en/7", "/[lang]/[id]", "/fr/*", "/de/[...rest]", "/", "/es/{id}")


@query(f"""
WITH p AS (SELECT pattern, list_filter(string_split(pattern, '/'), lambda x: x <> '') AS ps FROM (VALUES {", ".join(f"('{r}')" for r in ROUTES)}) v(pattern)),
q AS (SELECT pattern, ps, list_transform(ps, lambda s: CASE WHEN s = '*' OR starts_with(s, '[...') THEN 'rest' WHEN regexp_matches(s, '^([{{][^}}]+[}}]|:.+|\\[[^\\]]+\\])$') THEN 'dyn' ELSE 'fix' END) AS k FROM p),
r AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS rs FROM pages),
h AS (SELECT page_id, pattern, CASE WHEN ps = rs THEN 1000000 ELSE list_sum(list_transform(k, lambda x: CASE x WHEN 'rest' THEN -100 WHEN 'dyn' THEN 1 ELSE 100 END)) END AS score FROM r CROSS JOIN q
  WHERE CASE WHEN list_contains(k, 'rest') THEN len(rs) >= list_position(k, 'rest') - 1 ELSE len(rs) = len(ps) END
    AND len(list_filter(range(1, len(ps) + 1), lambda i: k[i] = 'rest' OR (i <= len(rs) AND (k[i] = 'dyn' OR ps[i] = rs[i])))) = len(ps))
SELECT page_id, pattern FROM (SELECT *, max(score) OVER (PARTITION BY page_id) AS m FROM h) WHERE score = m
""")
def route_best_match(spark, d):
    """Pages with their best observed routes by specificity, ties kept (other rules than the endpoint templates)."""
    r = load(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    return op.match_routes(r, spark.createDataFrame([(x,) for x in ROUTES], "pattern string"), "path", "page_id")


_HOST = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


@query(f"""
WITH o AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS dir, min(page_id) AS owner FROM pages GROUP BY 1 UNION ALL SELECT regexp_extract(url, '^[a-z]+://([^/?#]+/[^/?#]+)', 1), 100000 + min(page_id) FROM pages GROUP BY 1),
p AS (SELECT DISTINCT array_to_string(list_filter(string_split({_HOST}, '/'), lambda x: x <> ''), '/') AS path FROM pages)
SELECT path, max_by(owner, length(dir)) AS owner FROM p LEFT JOIN o ON path = dir OR starts_with(path, dir || '/') GROUP BY path
""")
def nearest_config(spark, d):
    """The deepest directory with an owner above each page address."""
    u = load(spark, d, "pages")
    path = F.array_join(F.filter(F.split(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/"), lambda x: x != ""), "/")
    host = u.groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("directory")).agg(F.min("page_id").alias("owner"))
    deep = u.groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]+/[^/?#]+)", 1).alias("directory")).agg((F.min("page_id") + 100000).alias("owner"))
    return op.nearest_ancestor(u.select(path.alias("path")).distinct(), host.union(deep), "path")


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 10 + (o_orderkey % 7) * 40 AS e FROM orders)
SELECT a.o_orderkey, b.o_orderkey AS "outer", row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.e - b.s, b.o_orderkey) AS level FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND b.s <= a.s AND b.e >= a.e AND a.o_orderkey <> b.o_orderkey
""")
def parent_containment(spark, d):
    """All windows of a customer that hold another, from the smallest out."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("s"), (day + 10 + (F.col("o_orderkey") % 7) * 40).alias("e"))
    return op.containers(o, "o_custkey", "s", "e", "o_orderkey", 64).withColumn("level", F.col("level").cast("bigint"))


@query("""
WITH e AS (SELECT user_id, event_type, max(CASE WHEN event_id % 2 = 0 THEN floor(value)::BIGINT END) AS b, max(CASE WHEN event_id % 2 = 1 THEN floor(value)::BIGINT END) AS h FROM events GROUP BY user_id, event_type),
p AS (SELECT user_id, event_type, b % 2 AS b, h % 2 AS h FROM e),
g AS (SELECT user_id, count(*) FILTER (b IS NULL OR h IS NULL OR b <> h) AS changed, bool_or(b IS NOT NULL) AS has FROM p GROUP BY user_id)
SELECT user_id, CASE WHEN NOT has THEN 'not_available' WHEN changed > 0 THEN 'changed' ELSE 'preserved' END AS status, CASE WHEN has THEN changed ELSE 0 END::BIGINT AS changed FROM g
""")
def baseline_comparison(spark, d):
    """Observations of a head run against those of a baseline, by check."""
    e = load(spark, d, "events").select("user_id", "event_type", "event_id", F.floor("value").alias("v"))
    run = lambda odd: e.where(F.col("event_id") % 2 == odd).where("v is not null").groupBy("user_id", "event_type").agg((F.max("v") % 2).alias("v"))
    plan = e.select("user_id", "event_type").distinct()
    return op.compare_runs(plan, run(0), run(1), "user_id", "event_type", "v")


@query("SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8)::BIGINT AS batch FROM documents")
def mission_batches(spark, d):
    """Documents of a source in fixed batches of eight."""
    return op.fixed_batches(load(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 8)


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_orderdate + INTERVAL 30 DAY AS lease_until FROM orders)
SELECT o_custkey, o_orderkey, status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM r WHERE status = 'pending' OR (status = 'running' AND lease_until < TIMESTAMP '1998-01-01')) WHERE rn = 1
""")
def claimable_runs(spark, d):
    """The oldest run of each customer that could be claimed at a time."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    r = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", status.alias("status"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("lease_until"))
    return op.claimable(r, F.lit("1998-01-01").cast("timestamp_ntz"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "status")


@query("""
WITH s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 ELSE 1 END AS s FROM events),
u AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS up FROM s),
l AS (SELECT *, least(0, min(up) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS low FROM u)
SELECT user_id, max_by(up - low, (ts, event_id))::BIGINT AS depth, count(*) FILTER (s < 0) AS branches FROM l GROUP BY user_id
""")
def branch_depth(spark, d):
    """How deep each user stands when errors lead back a step and never below the start."""
    step = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "view", 0).otherwise(1)
    return op.clamped_depth(load(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], step)


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS risk FROM lineitem)
SELECT * FROM r ORDER BY risk, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100
""")
def topk_findings(spark, d):
    """The hundred first findings by five keys (a top-k report)."""
    risk = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    x = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", risk.alias("risk"))
    return x.orderBy("risk", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(100)
