"""Queries that search paths by an automaton of steps, and what a change of sources affects, over the graph of foreign keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.tables import cut
from strandline.operators import impact, paths as op, refresh
from strandline.operators.rows import tasks_for
from strandline.plans import graphs as base
from strandline.plans.graphs import _id
from strandline.plans.registry import SQL, load, query

#: From a part to its orders, on to the buyer or the supplier, to either one's nation and its region.
ROUTE = [
    ("changed", "LISTS", "part", "order", "reverse", "ordered"),
    ("ordered", "PLACED_BY", "order", "customer", "forward", "sold"),
    ("ordered", "SUPPLIED_BY", "order", "supplier", "forward", "bought"),
    ("sold", "LIVES_IN", "customer", "nation", "forward", "placed"),
    ("bought", "SITS_IN", "supplier", "nation", "forward", "placed"),
    ("placed", "WITHIN", "nation", "region", "forward", "placed"),
]
KINDS = {"p": "part", "o": "order", "c": "customer", "s": "supplier", "n": "nation", "r": "region"}


def graph(spark, d):
    """Nodes and edges of all foreign keys: a line joins its order with a part (LISTS) and with a supplier (SUPPLIED_BY)."""
    t = {x: load(spark, d, x) for x in ("part", "orders", "customer", "supplier", "nation", "region", "lineitem")}
    node = lambda df, prefix, key, title: df.select(_id(prefix, key).alias("id"), F.lit(KINDS[prefix]).alias("kind"), title.alias("title"))
    nodes = node(t["part"], "p", "p_partkey", F.col("p_name")).union(node(t["orders"], "o", "o_orderkey", F.lit(""))).union(node(t["customer"], "c", "c_custkey", F.col("c_name")))
    nodes = nodes.union(node(t["supplier"], "s", "s_suppkey", F.col("s_name"))).union(node(t["nation"], "n", "n_nationkey", F.col("n_name"))).union(node(t["region"], "r", "r_regionkey", F.col("r_name")))
    same = {"tier": F.lit("A"), "review": F.lit("accepted"), "application_id": F.lit("app"), "revision": F.lit(1)}
    nodes = nodes.withColumns(same)
    line = F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")  # names one line
    tier = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")
    review = F.when(F.col("l_linestatus") == "F", "accepted").otherwise(F.when(tier == "C", "pending").otherwise("not_required"))
    stale = F.col("l_discount") >= 0.1

    def edge(df, kind, ident, a, b, evidence, t=same["tier"], r=same["review"], s=F.lit(False)):
        return df.select(ident.alias("edge_id"), a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), t.alias("tier"), r.alias("review"), s.alias("stale"), F.array(evidence).alias("evidence_ids"))

    li = t["lineitem"]
    e = edge(li, "LISTS", line, _id("o", "l_orderkey"), _id("p", "l_partkey"), line, tier, review, stale)
    e = e.union(edge(li, "SUPPLIED_BY", F.concat(line, F.lit("s")), _id("o", "l_orderkey"), _id("s", "l_suppkey"), line, tier, review, stale))
    for df, kind, a, ka, b, kb in ((t["orders"], "PLACED_BY", "o", "o_orderkey", "c", "o_custkey"), (t["customer"], "LIVES_IN", "c", "c_custkey", "n", "c_nationkey"), (t["supplier"], "SITS_IN", "s", "s_suppkey", "n", "s_nationkey"), (t["nation"], "WITHIN", "n", "n_nationkey", "r", "n_regionkey")):
        e = e.union(edge(df, kind, _id(a, ka), _id(a, ka), _id(b, kb), _id(a, ka)))
    return nodes, e.withColumn("application_id", F.lit("app")).withColumn("revision", F.lit(1)).withColumn("conflict_ids", F.array().cast("array<string>"))


def _brand(spark, d):
    return load(spark, d, "part").where("p_brand = 'Brand#1'").select(_id("p", "p_partkey").alias("id"), "p_partkey", "p_name", "p_type")


def _confident(edges):
    return edges.where("tier in ('A', 'B') and review in ('accepted', 'not_required') and not stale")


_GRAPH = """l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, concat_ws('-', 'l', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS id FROM lineitem WHERE l_discount < 0.1 AND (l_returnflag IN ('A', 'N'))),
e AS (SELECT id AS edge_id, 'LISTS' AS type, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM l UNION ALL SELECT id || 's', 'SUPPLIED_BY', 'o' || l_orderkey, 's' || l_suppkey FROM l
  UNION ALL SELECT 'o' || o_orderkey, 'PLACED_BY', 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'c' || c_custkey, 'LIVES_IN', 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'SITS_IN', 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'WITHIN', 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
b AS (SELECT edge_id, type, src AS a, dst AS b, 'forward' AS way FROM e UNION ALL SELECT edge_id, type, dst, src, 'reverse' FROM e),
t(state, type, fk, tk, way, next) AS (VALUES """ + ", ".join(
    "('{}', '{}', '{}', '{}', '{}', '{}')".format(s, t, a[0] if a != "supplier" else "s", b[0] if b != "supplier" else "s", w, n) for s, t, a, b, w, n in ROUTE
) + """),
x AS (SELECT state, next, edge_id, a, b FROM b JOIN t ON t.type = b.type AND t.way = b.way AND t.fk = b.a[1] AND t.tk = b.b[1]),
w(seed, here, state, nodes, edges) AS (SELECT 'p' || p_partkey, 'p' || p_partkey, 'changed', ['p' || p_partkey], []::VARCHAR[] FROM part WHERE p_brand = 'Brand#1'
  UNION ALL SELECT w.seed, x.b, x.next, list_append(w.nodes, x.b), list_append(w.edges, x.edge_id) FROM w JOIN x ON x.a = w.here AND x.state = w.state WHERE len(w.edges) < 4),
h AS (SELECT seed, here AS target, len(edges) AS hops, nodes, edges, min(len(edges)) OVER (PARTITION BY seed, here) AS least FROM w WHERE state IN ('sold', 'placed') AND here[1] IN ('c', 'n', 'r'))"""


def _found(spark, d):
    nodes, edges = graph(spark, d)
    return op.search(nodes, _confident(edges), _brand(spark, d), ROUTE, ("customer", "nation", "region"), 4, "changed", ("sold", "placed"))


@query(f"WITH RECURSIVE {_GRAPH} SELECT seed, target, hops::INTEGER AS hops, array_to_string(nodes, '>') AS nodes, array_to_string(edges, '>') AS edges FROM h WHERE hops = least")
def impact_search(spark, d):
    """All shortest paths of confident edges from a brand's parts to customers, nations and regions, by buyer or by supplier."""
    return _found(spark, d).select("seed", "target", "hops", F.array_join("nodes", ">").alias("nodes"), F.array_join("edges", ">").alias("edges"))


@query(f"""
WITH RECURSIVE {_GRAPH} SELECT sha256('{{"nodes":["' || array_to_string(nodes, '","') || '"],"edges":["' || array_to_string(edges, '","') || '"]}}') AS path_id, seed, target, hops::INTEGER AS hops,
  array_to_string(list_sort(list_distinct([p_type, p_name])), ',') AS symbols FROM h JOIN part ON 'p' || p_partkey = seed WHERE hops = least
""")
def impact_paths_by_symbol(spark, d):
    """The paths found, by content address, with the symbols whose change seeds them."""
    changed = _brand(spark, d).select(F.col("id").alias("seed"), F.explode(F.array("p_type", "p_name")).alias("symbol"))
    return op.normalised(_found(spark, d), changed).select("path_id", "seed", "target", "hops", F.array_join("symbols", ",").alias("symbols"))


def _clean(spark, d):
    """Candidates found by search from a brand's parts, without those that have a caveat."""
    nodes, edges = graph(spark, d)
    edges = edges.where(F.col("type").isin(sorted({x[0] for x in base.STEPS})))
    parts = _brand(spark, d)
    found = op.search(nodes, edges, parts, op.one_state(base.STEPS), ("region",), 4)
    change = F.element_at(F.array(*[F.lit(v) for v in ("deleted", "modified", "added", "moved")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    cand = op.candidates(found, nodes, edges, parts.select(F.col("id").alias("seed"), change.alias("operation")), ("customer", "nation", "region"))
    flagged = impact.caveats(cand, "app", 1, base.STEPS, ("customer", "nation", "region"))
    return cut(flagged.where(F.size("codes") == 0), "clean")


def _findings(spark, d, clean):
    critical = load(spark, d, "region").select(_id("r", "r_regionkey").alias("target_id"), F.lit("critical").alias("criticality")).union(load(spark, d, "nation").select(_id("n", "n_nationkey"), F.lit("important")))
    return impact.findings(impact.merged_paths(clean), critical)


@query(SQL["blast_radius"])
def impact_found(spark, d):
    """The ranked impact of a brand's parts, its candidates found by search instead of joins that are written out."""
    return _findings(spark, d, _clean(spark, d))


@query(f"""
WITH {base._IMPACT}, p AS (SELECT DISTINCT seed, target, kind, l_orderkey, c_custkey, n_nationkey, r_regionkey FROM cand WHERE NOT pending AND NOT stale),
r AS (SELECT target_id, risk FROM ({SQL["blast_radius"]}))
SELECT target AS target_id, CASE p.kind WHEN 'region' THEN 'requirement_acceptance' WHEN 'customer' THEN 'workflow_checkpoint' ELSE 'ui_interaction' END AS kind, 'c' || c_custkey AS workflow_id,
  CASE WHEN p.kind = 'region' THEN 'r' || r_regionkey END AS requirement_id, 'c' || c_custkey || CASE WHEN p.kind <> 'customer' THEN ',n' || n_nationkey ELSE '' END || CASE WHEN p.kind = 'region' THEN ',r' || r_regionkey ELSE '' END AS checkpoints,
  risk AS priority, count(*) AS n FROM p JOIN r ON target_id = target GROUP BY ALL
""")
def impact_scenarios(spark, d):
    """What to verify for the paths of every finding, counted by what they ask for: buyers as workflows, regions as requirements."""
    clean = _clean(spark, d)
    x = impact.scenarios(clean, _findings(spark, d, clean), "customer", "region", ("customer", "nation", "region"), limit=1 << 30)
    return x.groupBy("target_id", "kind", "workflow_id", "requirement_id", F.array_join("checkpoint_ids", ",").alias("checkpoints"), "priority").agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT src, dst FROM (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)),
b AS (SELECT * FROM e UNION ALL SELECT dst, src FROM e),
w(seed, here, nodes) AS (SELECT 's' || s_suppkey, 's' || s_suppkey, ['s' || s_suppkey] FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT seed, b.dst, list_append(nodes, b.dst) FROM w JOIN b ON b.src = w.here WHERE len(nodes) < 5 AND NOT list_contains(nodes, b.dst)),
h AS (SELECT seed, here AS target, len(nodes) - 1 AS hops, nodes FROM w WHERE here[1] = 'r'),
f AS (SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY hops, nodes) AS k FROM h)
SELECT seed, target, hops::INTEGER AS hops, array_to_string(nodes, '>') AS nodes FROM f WHERE k = 1 ORDER BY hops, seed, target LIMIT 100
""")
def change_seed_paths(spark, d):
    """One shortest path, whatever its direction, from each supplier in debt to each region within reach; the first hundred (a report's size)."""
    nodes, edges = graph(spark, d)
    steps = op.one_state([("SITS_IN", "supplier", "nation", "any"), ("SITS_IN", "nation", "supplier", "any"), ("WITHIN", "nation", "region", "any"), ("WITHIN", "region", "nation", "any")])
    seeds = load(spark, d, "supplier").where("s_acctbal < 0").select(_id("s", "s_suppkey").alias("id"))
    found = op.search(nodes, _confident(edges), seeds, steps, ("region",), 4)
    one = found.groupBy("seed", "target").agg(F.min(F.struct("hops", "nodes", "edges")).alias("p"))
    return one.select("seed", "target", "p.hops", F.array_join("p.nodes", ">").alias("nodes")).orderBy("hops", "seed", "target").limit(100)


def _inventory(spark, d):
    """Parts are symbols in files of their brand's folder, orders are workflows that depend on their parts, customers are requirements that
    their orders cover; a requirement depends on its urgent orders."""
    p, o, li, c = (load(spark, d, t) for t in ("part", "orders", "lineitem", "customer"))
    none = F.array().cast("array<string>")
    parts = p.select(_id("p", "p_partkey").alias("id"), F.lit("code-symbol").alias("kind"), F.array(F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#")), F.lit("/"), "p_partkey", F.lit(".ts"))).alias("source_paths"), none.alias("depends_on_ids"), (F.col("p_size") == 50).alias("stale"))
    tasks = tasks_for(li, o, c)
    uses = li.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set(_id("p", "l_partkey")).alias("depends_on_ids")).hint("shuffle_hash")
    orders = o.select("o_orderkey").repartition(tasks, "o_orderkey").join(uses, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(_id("o", "o_orderkey"), F.lit("workflow"), none, F.coalesce("depends_on_ids", none), F.lit(False))
    big = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey").repartition(tasks, "o_custkey").groupBy("o_custkey").agg(F.collect_set(_id("o", "o_orderkey")).alias("depends_on_ids")).hint("shuffle_hash")
    custs = c.select("c_custkey", "c_mktsegment").repartition(tasks, "c_custkey").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select(_id("c", "c_custkey"), F.lit("requirement"), F.array(F.concat(F.lit("docs/"), "c_mktsegment", F.lit(".md"))), F.coalesce("depends_on_ids", none), F.lit(False))
    review = F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("pending")
    links = o.select(_id("l", "o_orderkey").alias("id"), _id("c", "o_custkey").alias("from_id"), _id("o", "o_orderkey").alias("to_id"), F.lit("COVERED_BY").alias("relationship"), review.alias("review_state"), F.array(F.concat(F.lit("links/"), "o_orderpriority")).alias("source_paths"))
    return parts.union(orders).union(custs), links


@query("""
WITH RECURSIVE dep AS (SELECT DISTINCT 'o' || l_orderkey AS id, 'p' || l_partkey AS on_id FROM lineitem UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'),
s AS (SELECT 'p' || p_partkey AS id, CASE WHEN p_brand = 'Brand#12' THEN 'source_changed' ELSE 'stale' END AS reason FROM part WHERE p_brand = 'Brand#12' OR p_size = 50),
w(id, hop) AS (SELECT id, 0 FROM s UNION SELECT dep.id, w.hop + 1 FROM w JOIN dep ON dep.on_id = w.id),
a AS (SELECT w.id, min(hop) AS hop, coalesce(min(s.reason), 'depends_on_affected') AS reason FROM w LEFT JOIN s USING (id) GROUP BY w.id),
ent AS (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 'o' || o_orderkey FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer),
q AS (SELECT id, 0 AS k FROM a WHERE id[1] = 'c' UNION ALL SELECT 'c' || o_custkey, 2 FROM orders WHERE 'o' || o_orderkey IN (SELECT id FROM a))
SELECT 'entity' AS subject, ent.id, CASE WHEN a.id IS NULL THEN 'reused' ELSE 'affected' END AS outcome, reason, hop::INTEGER AS hop FROM ent LEFT JOIN a ON a.id = ent.id
UNION ALL SELECT 'link', 'l' || o_orderkey, CASE WHEN f.id IS NOT NULL OR g.id IS NOT NULL OR o_orderpriority = '5-LOW' THEN 'invalidated' WHEN o_orderstatus = 'F' THEN 'reusable' ELSE 'unreviewed' END,
  CASE WHEN f.id IS NOT NULL THEN 'from_affected' WHEN g.id IS NOT NULL THEN 'to_affected' WHEN o_orderpriority = '5-LOW' THEN 'source_changed' END, NULL FROM orders LEFT JOIN a f ON f.id = 'c' || o_custkey LEFT JOIN a g ON g.id = 'o' || o_orderkey
UNION ALL SELECT 'requirement', q.id, 'reassess', CASE min(k) WHEN 0 THEN 'affected' ELSE 'covered_by_workflow' END, any_value(a.hop)::INTEGER FROM q LEFT JOIN a ON a.id = q.id GROUP BY q.id
""")
def refresh_scope(spark, d):
    """What a change of a brand's folder and of some links' sources means for every entity, link and requirement, with reason and distance."""
    entities, links = _inventory(spark, d)
    changed = spark.createDataFrame([("src/Brand12",), ("links/5-LOW",)], "path string")
    return refresh.plan(entities, links, changed)
