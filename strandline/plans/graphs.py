"""Queries over the graph of foreign keys, ending in the ranked impact report."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import graphs as op, impact
from strandline.plans.registry import load, query


def _id(prefix: str, c):
    return F.concat(F.lit(prefix), F.col(c) if isinstance(c, str) else c)


def _edges(spark, d):
    """All foreign keys as edges between prefixed ids."""
    n, c, s, o = (load(spark, d, t) for t in ("nation", "customer", "supplier", "orders"))
    e = n.select(_id("n", "n_nationkey").alias("src"), _id("r", "n_regionkey").alias("dst"))
    e = e.union(c.select(_id("c", "c_custkey"), _id("n", "c_nationkey"))).union(s.select(_id("s", "s_suppkey"), _id("n", "s_nationkey")))
    return e.union(o.select(_id("o", "o_orderkey"), _id("c", "o_custkey")))


_EDGES = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


@query(f"""
WITH RECURSIVE {_EDGES}, b AS (SELECT * FROM e UNION ALL SELECT dst, src FROM e),
w(id, dist) AS (SELECT 'n3', 0 UNION SELECT b.dst, w.dist + 1 FROM w JOIN b ON b.src = w.id WHERE w.dist < 3) SELECT id, min(dist)::INTEGER AS dist FROM w GROUP BY id
""")
def neighborhood(spark, d):
    """Everything within three steps of a nation, by least distance."""
    seeds = spark.createDataFrame([("n3",)], "id string")
    return op.neighbourhood(op.symmetrise(_edges(spark, d)), seeds, 3)[0]


@query(f"""
WITH RECURSIVE {_EDGES}, b AS (SELECT * FROM e UNION ALL SELECT dst, src FROM e),
w(id, dist) AS (SELECT 'n3', 0 UNION SELECT b.dst, w.dist + 1 FROM w JOIN b ON b.src = w.id WHERE w.dist < 2), n AS (SELECT DISTINCT id FROM w)
SELECT src, dst FROM e WHERE src IN (FROM n) AND dst IN (FROM n)
""")
def induced_edges(spark, d):
    """The edges among everything within two steps of a nation."""
    e = _edges(spark, d)
    nodes, _ = op.neighbourhood(op.symmetrise(e), spark.createDataFrame([("n3",)], "id string"), 2)
    ids = nodes.select("id")
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def _chain(spark, d, parts):
    """Typed edges from parts over orders and customers to nations."""
    li, o, c = load(spark, d, "lineitem"), load(spark, d, "orders"), load(spark, d, "customer")
    e = li.join(parts.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(_id("p", "l_partkey").alias("src"), _id("o", "l_orderkey").alias("dst"))
    return e.union(o.select(_id("o", "o_orderkey"), _id("c", "o_custkey"))).union(c.select(_id("c", "c_custkey"), _id("n", "c_nationkey")))


@query("""
SELECT DISTINCT 'p' || p_partkey AS source, 'n' || c_nationkey AS target, 3 AS hops, array_to_string(['p' || p_partkey, 'o' || o_orderkey, 'c' || c_custkey, 'n' || c_nationkey], '>') AS nodes
FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE p_brand = 'Brand#1' AND p_size <= 5 AND c_nationkey < 5
""")
def all_shortest_paths(spark, d):
    """All shortest paths from some parts to some nations over orders and customers."""
    p = load(spark, d, "part").where("p_brand = 'Brand#1' and p_size <= 5")
    goals = load(spark, d, "nation").where("n_nationkey < 5").select(_id("n", "n_nationkey").alias("id"))
    x = op.shortest_paths(_chain(spark, d, p), p.select(_id("p", "p_partkey").alias("id")), goals, 4)
    return x.withColumn("nodes", F.array_join("nodes", ">"))


_NATIONS = "(SELECT n_nationkey AS edge_id, n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION ALL SELECT 100 + n_nationkey, n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation)"


@query(f"""
WITH RECURSIVE e AS (SELECT * FROM {_NATIONS} WHERE src <> dst), b AS (SELECT * FROM e UNION ALL SELECT edge_id, dst, src FROM e),
w(here, nodes, edges) AS (SELECT 0, [0], []::INTEGER[] UNION ALL SELECT b.dst, list_append(nodes, b.dst), list_append(edges, b.edge_id) FROM w JOIN b ON b.src = w.here WHERE len(edges) < 5 AND NOT list_contains(edges, b.edge_id))
SELECT array_to_string(nodes, '>') AS nodes, array_to_string(edges, '>') AS edges, len(edges)::INTEGER AS hops FROM w WHERE here = 5 AND len(edges) > 0
""")
def evidence_trails(spark, d):
    """All trails of at most five edges between two nations of a small graph: no edge twice."""
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n"))
    e = n.select(F.col("n").alias("edge_id"), F.col("n").alias("src"), ((F.col("n") * 7 + 3) % 25).alias("dst")).union(n.select(F.col("n") + 100, "n", (F.col("n") * 3 + 1) % 25)).where("src <> dst")
    x = op.trails(e, spark.createDataFrame([(0,)], "id int"), spark.createDataFrame([(5,)], "id int"), 5)
    return x.select(F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), F.array_join(F.col("edges").cast("array<string>"), ">").alias("edges"), F.size("edges").alias("hops"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS id, 'p' || l_partkey AS on_id FROM lineitem UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
w(id) AS (SELECT 'p' || p_partkey FROM part WHERE p_brand = 'Brand#1' UNION SELECT e.id FROM w JOIN e ON e.on_id = w.id) SELECT id FROM w
""")
def dependency_closure(spark, d):
    """Everything that depends, directly or not, on the parts of a brand."""
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    e = li.select(_id("o", "l_orderkey").alias("id"), _id("p", "l_partkey").alias("on_id")).union(o.select(_id("c", "o_custkey"), _id("o", "o_orderkey")))
    return op.closure(e, load(spark, d, "part").where("p_brand = 'Brand#1'").select(_id("p", "p_partkey").alias("id")))


_BIPARTITE = """e AS (SELECT DISTINCT 2 * l_orderkey AS a, 2 * l_partkey + 1 AS b FROM lineitem), s AS (SELECT * FROM e UNION ALL SELECT b, a FROM e),
cc(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM s UNION
  (SELECT s.b, min(cc.component) FROM cc JOIN s ON s.a = cc.id JOIN recurring.cc AS r ON r.id = s.b WHERE cc.component < r.component GROUP BY s.b))"""


@query(f"WITH RECURSIVE {_BIPARTITE} SELECT id, component FROM cc")
def components(spark, d):
    """Connected components of orders and parts over every line."""
    return op.components(load(spark, d, "lineitem").select((2 * F.col("l_orderkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst")))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL),
w(id, dist) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, w.dist + 1 FROM w JOIN e ON e.src = w.id WHERE w.dist < 6) SELECT id, min(dist)::INTEGER AS dist FROM w GROUP BY id
""")
def callers_trace(spark, d):
    """Who is reached from a user over the targets that events name, with the least depth up to six."""
    e = load(spark, d, "events").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").try_cast("bigint").alias("dst")).where("dst is not null")
    return op.distances(e, spark.createDataFrame([(0, 0)], "seed int, id bigint"), 6).select("id", "dist")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT a.o_orderkey, b.o_orderkey AS root, least(a.rn - 1, 20)::INTEGER AS hops FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND b.rn = greatest(1, a.rn - 20)
""")
def recursive_lineage(spark, d):
    """Each order with its ancestor at most twenty orders back in the customer's chain."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"))
    return op.lineage(o, "o_orderkey", "before", 20)


@query("""
SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO' AND p_size < 10)
""")
def reachability_gap(spark, d):
    """Customers who reach no small part of a type within two steps."""
    o, li, p = load(spark, d, "orders"), load(spark, d, "lineitem"), load(spark, d, "part")
    kind = F.when((F.col("p_type") == "PROMO") & (F.col("p_size") < 10), "wanted").otherwise("part")
    parts = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select((2 * F.col("l_orderkey") + 1).alias("src"), (-1 - F.col("l_partkey")).alias("dst"), kind.alias("dst_kind"))
    e = o.select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("o_orderkey") + 1).alias("dst"), F.lit("order").alias("dst_kind")).union(parts)
    starts = load(spark, d, "customer").select((2 * F.col("c_custkey")).alias("id"))
    return op.without_path(starts, e, F.col("dst_kind") == "wanted", 2).select((F.col("id") / 2).cast("bigint").alias("id"))


@query("""
SELECT r_name, count(*) AS complete, count(DISTINCT c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey GROUP BY r_name
""")
def complete_paths(spark, d):
    """By region: complete chains from region to part whose supplier is of the customer's nation."""
    t = {x: load(spark, d, x) for x in ("region", "nation", "customer", "orders", "lineitem", "supplier", "part")}
    x = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey").join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey")).join(t["part"].select("p_partkey"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    x = x.join(t["orders"].select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t["customer"].select("c_custkey", "c_nationkey"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    x = x.join(t["nation"], F.col("n_nationkey") == F.col("c_nationkey")).join(t["region"], F.col("r_regionkey") == F.col("n_regionkey"))
    return x.groupBy("r_name", "c_custkey").count().groupBy("r_name").agg(F.sum("count").alias("complete"), F.count("*").alias("customers"))


#: The steps of the report over foreign keys.
STEPS = (("LISTS", "part", "order", "reverse"), ("PLACED_BY", "order", "customer", "forward"), ("LIVES_IN", "customer", "nation", "forward"), ("WITHIN", "nation", "region", "forward"))


def impact_candidates(spark, d, brand: str):
    """One candidate path by line of the brand's parts and target (customer, nation, region)."""
    p = load(spark, d, "part").where(F.col("p_brand") == brand).select("p_partkey")
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount")
    x = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = x.join(load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(load(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    ids = {"part": _id("p", "l_partkey"), "order": _id("o", "l_orderkey"), "customer": _id("c", "c_custkey"), "nation": _id("n", "n_nationkey"), "region": _id("r", "r_regionkey")}
    node = lambda k: F.struct(ids[k].alias("id"), F.lit(k).alias("kind"), F.lit("A").alias("tier"), F.lit("accepted").alias("review"), F.lit("app").alias("application_id"), F.lit(1).alias("revision"))
    tier = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")
    review = F.when(F.col("l_linestatus") == "F", "accepted").otherwise(F.when(tier == "C", "pending").otherwise("not_required"))
    line = F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_suppkey")

    def hop(kind, a, b, evidence, t=F.lit("A"), r=F.lit("accepted"), stale=F.lit(False)):
        return F.struct(F.lit(kind).alias("type"), ids[a].alias("from_id"), ids[b].alias("to_id"), t.alias("tier"), r.alias("review"), F.lit("app").alias("application_id"), F.lit(1).alias("revision"), stale.alias("stale"), F.array(evidence).alias("evidence_ids"), F.array().cast("array<string>").alias("conflict_ids"))

    hops = [hop("LISTS", "order", "part", line, tier, review, F.col("l_discount") >= 0.1), hop("PLACED_BY", "order", "customer", ids["order"]), hop("LIVES_IN", "customer", "nation", ids["customer"]), hop("WITHIN", "nation", "region", ids["nation"])]
    kinds = ["part", "order", "customer", "nation", "region"]
    targets = [
        F.struct(F.lit(k).alias("target_kind"), ids[k].alias("target_id"), title.alias("title"), F.array(*[node(x) for x in kinds[: i + 1]]).alias("nodes"), F.array(*hops[:i]).alias("hops"))
        for i, (k, title) in enumerate([("part", F.lit("")), ("order", F.lit("")), ("customer", F.col("c_name")), ("nation", F.col("n_name")), ("region", F.col("r_name"))])
        if i >= 2
    ]
    op_name = F.element_at(F.array(*[F.lit(v) for v in ("deleted", "modified", "added", "moved")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    x = x.select(ids["part"].alias("seed_id"), op_name.alias("operation"), line.alias("line"), F.explode(F.array(*targets)).alias("t"))
    return x.select("seed_id", "operation", F.concat_ws(">", "line", "t.target_id").alias("candidate_id"), "t.*")


_IMPACT = """
line AS (SELECT 'p' || l_partkey AS seed, CASE l_partkey % 4 WHEN 0 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS change, l_orderkey, concat_ws('-', 'l', l_orderkey, l_linenumber, l_suppkey) AS id,
  CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS tier, l_returnflag NOT IN ('A', 'N') AND l_linestatus <> 'F' AS pending, l_discount >= 0.1 AS stale,
  c_custkey, c_name, n_nationkey, n_name, r_regionkey, r_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE p_brand = 'Brand#1'),
cand AS (SELECT *, 'c' || c_custkey AS target, 'customer' AS kind, c_name AS title, 2 AS hops FROM line UNION ALL SELECT *, 'n' || n_nationkey, 'nation', n_name, 3 FROM line UNION ALL SELECT *, 'r' || r_regionkey, 'region', r_name, 4 FROM line)"""


@query(f"""
WITH {_IMPACT}, paths AS (SELECT seed, target, kind, title, hops, min(change) AS change, min(tier) AS tier, count(DISTINCT id) AS cands, count(DISTINCT id) + hops - 1 AS evidence
  FROM cand WHERE NOT pending AND NOT stale GROUP BY seed, target, kind, title, hops, l_orderkey, c_custkey),
spread AS (SELECT seed, count(DISTINCT target) AS spread FROM paths GROUP BY seed),
f AS (SELECT target AS target_id, kind AS target_kind, min(title) AS title, max(change) AS change, min(hops) AS depth, max(spread) AS spread, max(CASE WHEN cands >= 2 AND evidence > hops THEN 1 ELSE 0 END) AS corroboration,
  min(tier) AS strength, count(*) AS paths, count(DISTINCT seed) AS seeds FROM paths JOIN spread USING (seed) GROUP BY target, kind),
s AS (SELECT *, CASE target_kind WHEN 'region' THEN 'critical' WHEN 'nation' THEN 'important' ELSE 'standard' END AS criticality, CASE target_kind WHEN 'region' THEN 4 WHEN 'nation' THEN 3 ELSE 2 END AS criticality_points,
  CASE WHEN depth <= 2 THEN 3 WHEN depth <= 5 THEN 2 ELSE 1 END AS directness, CASE WHEN spread >= 5 THEN 3 WHEN spread >= 2 THEN 2 ELSE 1 END AS breadth, CASE WHEN spread >= 2 THEN 2 ELSE 0 END AS shared FROM f),
t AS (SELECT *, change + criticality_points + directness + breadth + shared + corroboration AS score FROM s)
SELECT target_id, target_kind, title, CASE WHEN score >= 10 THEN 'high' WHEN score >= 6 THEN 'medium' ELSE 'low' END AS risk, score::INTEGER AS score, strength, criticality, change::INTEGER AS change, criticality_points::INTEGER AS criticality_points,
  directness::INTEGER AS directness, breadth::INTEGER AS breadth, shared::INTEGER AS shared, corroboration::INTEGER AS corroboration, paths, seeds FROM t
""")
def blast_radius(spark, d):
    """The flagship: ranked impact of changing a brand's parts on customers, nations and regions, with its factors."""
    flagged = impact.caveats(impact_candidates(spark, d, "Brand#1"), "app", 1, STEPS, ("customer", "nation", "region"))
    paths = impact.merged_paths(flagged.where(F.size("codes") == 0))
    critical = load(spark, d, "region").select(_id("r", "r_regionkey").alias("target_id"), F.lit("critical").alias("criticality")).union(load(spark, d, "nation").select(_id("n", "n_nationkey"), F.lit("important")))
    found = impact.findings(paths, critical)
    return found.orderBy(*impact.report_order(found))


@query(f"""
WITH {_IMPACT}, c AS (SELECT id || '>' || target AS candidate_id, unnest(list_filter([CASE WHEN pending THEN 'review_unresolved' END, CASE WHEN stale THEN 'stale_revision' END], lambda x: x IS NOT NULL)) AS code FROM cand)
SELECT code, count(*) AS n, count(DISTINCT candidate_id) AS candidates FROM c GROUP BY code
""")
def blast_radius_caveats(spark, d):
    """Why candidate paths prove nothing, counted by reason."""
    flagged = impact.caveats(impact_candidates(spark, d, "Brand#1"), "app", 1, STEPS, ("customer", "nation", "region"))
    x = flagged.select("candidate_id", F.explode("codes").alias("code"))
    return x.groupBy("code", "candidate_id").count().groupBy("code").agg(F.sum("count").alias("n"), F.count("*").alias("candidates"))
