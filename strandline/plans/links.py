"""Queries that search, trace and link over the graph of foreign keys, and label names, paths and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import rules
from strandline.functions import text as tx
from strandline.operators import links as op
from strandline.plans.graphs import _EDGES, _edges, _id
from strandline.plans.registry import load, query


def _nodes(spark, d):
    p, c, s, n = (load(spark, d, t) for t in ("part", "customer", "supplier", "nation"))
    one = lambda df, prefix, key, kind, title: df.select(_id(prefix, key).alias("id"), F.lit(kind).alias("kind"), F.col(title).alias("title"))
    return (
        one(p, "p", "p_partkey", "part", "p_name").union(one(c, "c", "c_custkey", "customer", "c_name"))
        .union(one(s, "s", "s_suppkey", "supplier", "s_name")).union(one(n, "n", "n_nationkey", "nation", "n_name"))
    )


_NODES = """n AS (SELECT 'p' || p_partkey AS id, 'part' AS kind, p_name AS title FROM part UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation)"""


@query(f"WITH {_NODES} SELECT id, kind, title FROM n WHERE contains(lower(title), 'bolt') AND kind IN ('part', 'supplier') ORDER BY title, id LIMIT 50")
def entity_search(spark, d):
    """The first fifty parts and suppliers with a word in their title, in any case (a search's page)."""
    return op.search(_nodes(spark, d), "Bolt", ["part", "supplier"], 50)


@query(f"WITH {_NODES} SELECT id, kind, title FROM n WHERE contains(lower(title), '1') ORDER BY title, id LIMIT 100")
def entity_search_of_all_kinds(spark, d):
    """The same search without a filter by kind."""
    return op.search(_nodes(spark, d), "1", None, 100)


def _typed(spark, d):
    """Foreign keys as typed edges with tiers and review states."""
    n, c, s, o = (load(spark, d, t) for t in ("nation", "customer", "supplier", "orders"))
    e = lambda df, src, dst, t, tier, review: df.select(src.alias("src"), dst.alias("dst"), F.lit(t).alias("type"), tier.alias("tier"), review.alias("review_state"))
    a, ok = F.lit("A"), F.lit("accepted")
    tier = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").otherwise("C")
    d = e(n, _id("n", "n_nationkey"), _id("r", "n_regionkey"), "WITHIN", a, ok).union(e(c, _id("c", "c_custkey"), _id("n", "c_nationkey"), "LIVES_IN", a, ok))
    d = d.union(e(s, _id("s", "s_suppkey"), _id("n", "s_nationkey"), "SITS_IN", a, ok))
    d = d.union(e(o, _id("o", "o_orderkey"), _id("c", "o_custkey"), "PLACED_BY", tier, F.when(tier == "C", "pending").otherwise("not_required")))
    return d.withColumn("edge_id", F.concat_ws(">", "src", "dst"))


_TYPED = """e AS (SELECT src || '>' || dst AS edge_id, * FROM (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'WITHIN' AS type, 'A' AS tier, 'accepted' AS review_state FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN', 'A', 'accepted' FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'SITS_IN', 'A', 'accepted' FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'PLACED_BY', CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'C' END, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'not_required' ELSE 'pending' END FROM orders))"""


@query(f"""
WITH RECURSIVE {_TYPED}, f AS (SELECT edge_id, src, dst FROM e WHERE type IN ('PLACED_BY', 'LIVES_IN', 'SITS_IN') AND tier IN ('A', 'B') AND review_state IN ('accepted', 'not_required')),
b AS (SELECT * FROM f UNION ALL SELECT edge_id, dst, src FROM f),
w(here, nodes, edges) AS (SELECT 'c1', ['c1'], []::VARCHAR[] UNION ALL SELECT b.dst, list_append(nodes, b.dst), list_append(edges, b.edge_id) FROM w JOIN b ON b.src = w.here WHERE len(edges) < 3 AND NOT list_contains(edges, b.edge_id)),
t AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'o' || o_orderkey FROM orders)
SELECT array_to_string(nodes, '>') AS nodes, len(edges)::INTEGER AS hops FROM (SELECT * FROM w JOIN t ON t.id = w.here WHERE len(edges) > 0 ORDER BY len(edges), edges, nodes LIMIT 200)
""")
def evidence_paths(spark, d):
    """Paths of confident edges from a customer to suppliers and orders, shortest first, at most two hundred (a report's size)."""
    ends = load(spark, d, "supplier").select(_id("s", "s_suppkey").alias("id")).union(load(spark, d, "orders").select(_id("o", "o_orderkey")))
    start = spark.createDataFrame([("c1",)], "id string")
    x = op.evidence_paths(_typed(spark, d), start, ends, 3, 200, types=["PLACED_BY", "LIVES_IN", "SITS_IN"], tiers=["A", "B"], reviews=["accepted", "not_required"])
    return x.select(F.array_join("nodes", ">").alias("nodes"), "hops")


@query(f"""
WITH RECURSIVE {_TYPED}, f AS (SELECT src, dst FROM e WHERE type IN ('LIVES_IN', 'SITS_IN', 'WITHIN') AND substr(src, 1, 1) IN ('c', 'n', 's') AND substr(dst, 1, 1) IN ('n', 's')), b AS (SELECT * FROM f UNION ALL SELECT dst, src FROM f),
w(id, dist) AS (SELECT 'n3', 0 UNION SELECT b.dst, w.dist + 1 FROM w JOIN b ON b.src = w.id WHERE w.dist < 2) SELECT id, min(dist)::INTEGER AS dist FROM w GROUP BY id ORDER BY dist, id LIMIT 40
""")
def scoped_neighborhood(spark, d):
    """The forty nearest customers, suppliers and nations around a nation over some relationships (a view's node limit)."""
    e = _typed(spark, d).select("src", "dst", "type")
    return op.scoped_neighbourhood(_nodes(spark, d), e, spark.createDataFrame([("n3",)], "id string"), 2, ["customer", "supplier", "nation"], ["LIVES_IN", "SITS_IN", "WITHIN"], 40)[0]


@query(f"""
WITH RECURSIVE {_EDGES}, w(id, dist) AS (SELECT 'n3', 0 UNION SELECT e.src, w.dist + 1 FROM w JOIN e ON e.dst = w.id WHERE w.dist < 6)
SELECT id, min(dist)::INTEGER AS dist FROM w WHERE dist > 0 GROUP BY id ORDER BY dist, id LIMIT 100
""")
def callers_limited(spark, d):
    """The hundred nearest that point to a nation over up to six steps (a trace's limit)."""
    return op.trace(_edges(spark, d), "n3", "callers", 6, 100)


@query("""
WITH hit AS (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO' AND p_size < 3)
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (FROM hit)
""")
def frontend_callers(spark, d):
    """Customers from whom a small part of a type is reached over orders and lines, by closure over all references."""
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    refs = o.select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst")).union(li.select(_id("o", "l_orderkey"), _id("p", "l_partkey")))
    parts = load(spark, d, "part").where("p_type = 'PROMO' and p_size < 3").select(_id("p", "p_partkey").alias("id"))
    roots = load(spark, d, "customer").select(_id("c", "c_custkey").alias("id"), "c_custkey", "c_mktsegment")
    return op.callers_at(parts, refs, roots).select("c_custkey", "c_mktsegment")


@query("""
SELECT 'o' || o_orderkey AS start, 3 AS hops, array_to_string(['o' || o_orderkey, 'c' || c_custkey, 'n' || c_nationkey, 'r' || n_regionkey], '>') AS nodes
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
""")
def requirement_paths(spark, d):
    """The longest directed path from each pending urgent order."""
    start = load(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(_id("o", "o_orderkey").alias("id"))
    return op.longest_paths(_edges(spark, d), start).withColumn("nodes", F.array_join("nodes", ">"))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER w AS k, o_orderdate FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
f AS (SELECT *, min(CASE WHEN k = 1 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS root FROM r)
SELECT root, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM f GROUP BY root
""")
def latest_retry(spark, d):
    """The newest of all orders that descend from a customer's first one, each the retry of the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate", F.lag("o_orderkey").over(w).alias("before"))
    return op.latest_descendants(o, "o_orderkey", "before", "o_orderdate")


@query("""
WITH p AS (SELECT s_nationkey AS n, s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, c_custkey) AS k FROM supplier JOIN customer ON c_nationkey = s_nationkey)
SELECT n, s_suppkey, c_custkey FROM p WHERE k <= 50
""")
def capped_comparisons(spark, d):
    """The first fifty pairs of suppliers and customers of each nation, in order (the limit of comparisons)."""
    s, c = load(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey"), load(spark, d, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey")
    return op.capped_pairs(s, c, "n", "s_suppkey", "c_custkey", 50)


@query("""
WITH c AS (SELECT l_orderkey AS id, min(CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END) AS tier, CASE WHEN bool_and(l_linestatus = 'F') THEN 'accepted' ELSE 'pending' END AS review, bool_or(l_discount >= 0.1) AS stale FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'D' ELSE 'B' END AS tier, 'not_required' AS review, false AS stale FROM orders WHERE o_orderstatus = 'P'),
u AS (SELECT * FROM p UNION ALL SELECT * FROM c WHERE id NOT IN (SELECT id FROM p))
SELECT id, tier, review FROM u WHERE NOT stale AND tier <> 'D' AND CASE WHEN tier = 'C' THEN review = 'accepted' ELSE review IN ('accepted', 'not_required') END
""")
def confident_links(spark, d):
    """Links after a pending batch has replaced those of its ids, without stale, weak and unreviewed ones."""
    tier = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")
    g = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(tier).alias("tier"), F.bool_and(F.col("l_linestatus") == "F").alias("f"), F.bool_or(F.col("l_discount") >= 0.1).alias("stale"))
    now = g.select("id", "tier", F.when(F.col("f"), "accepted").otherwise("pending").alias("review"), "stale")
    o = load(spark, d, "orders").where("o_orderstatus = 'P'")
    new = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 300000, "D").otherwise("B").alias("tier"), F.lit("not_required").alias("review"), F.lit(False).alias("stale"))
    return op.override(now, new, "id").where(op.confident(F.col("tier"), F.col("review"), F.col("stale"))).select("id", "tier", "review")


#: Which source a method may use, in the evidence query.
METHODS = (("MAIL", "A"), ("SHIP", "N"), ("AIR", "R"), ("AIR", "A"))


@query(f"""
WITH m(method, source) AS (VALUES {", ".join(str(x) for x in METHODS)}), e AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_tax >= 0.08 THEN 'other' ELSE 'app' END AS app, l_linestatus, CASE l_linenumber % 3 WHEN 0 THEN 'MAIL' WHEN 1 THEN 'SHIP' ELSE 'AIR' END AS method, l_returnflag, l_suppkey AS run,
  CASE WHEN l_quantity > 10 THEN l_partkey END AS sha FROM lineitem),
r AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), c AS (SELECT p_partkey FROM part WHERE p_size > 10)
SELECT code, count(*) AS n FROM (SELECT CASE WHEN app <> 'app' THEN 'application_mismatch' WHEN l_linestatus <> 'F' THEN 'invalid_evidence_status' WHEN (method, l_returnflag) NOT IN (FROM m) THEN 'unsupported_source'
  WHEN run NOT IN (FROM r) THEN 'incompatible_run' WHEN sha IS NOT NULL AND sha NOT IN (FROM c) THEN 'incompatible_commit' END AS code FROM e) GROUP BY code
""")
def evidence_compatibility(spark, d):
    """Why evidence does not count, by the first reason (null: it counts)."""
    method = F.element_at(F.array(F.lit("MAIL"), F.lit("SHIP"), F.lit("AIR")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    e = load(spark, d, "lineitem").select(
        F.when(F.col("l_tax") >= 0.08, "other").otherwise("app").alias("application_id"), F.col("l_linestatus").alias("status"), method.alias("method"),
        F.col("l_returnflag").alias("source_kind"), F.col("l_suppkey").alias("run_id"), F.when(F.col("l_quantity") > 10, F.col("l_partkey")).alias("commit_sha"),
    )
    runs = load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("run_id"))
    commits = load(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("commit_sha"))
    methods = spark.createDataFrame(list(METHODS), "method string, source_kind string")
    return op.compatibility(e, "app", ["F"], methods, runs, commits).groupBy("code").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT l_suppkey AS from_id, l_returnflag AS relationship, l_partkey AS to_id, CASE WHEN l_linestatus = 'F' THEN 'supports' ELSE 'contradicts' END AS assertion, CASE WHEN l_quantity > 25 THEN 'A' ELSE 'B' END AS tier,
  CASE WHEN l_tax > 0.04 THEN 'static' ELSE 'runtime' END AS method, l_orderkey AS e FROM lineitem)
SELECT from_id, relationship, to_id, min(tier) AS tier, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods, array_to_string(list_sort(list(DISTINCT e)), ',') AS evidence_ids,
  count(*) FILTER (assertion = 'supports') > 0 AND count(*) FILTER (assertion = 'contradicts') > 0 AS conflict FROM c GROUP BY ALL
""")
def claim_links(spark, d):
    """One link by supplier, flag and part with the best tier, all methods and evidence, and contradictions."""
    li = load(spark, d, "lineitem")
    c = li.select(
        F.col("l_suppkey").alias("from_id"), F.col("l_returnflag").alias("relationship"), F.col("l_partkey").alias("to_id"), F.when(F.col("l_linestatus") == "F", "supports").otherwise("contradicts").alias("assertion"),
        F.when(F.col("l_quantity") > 25, "A").otherwise("B").alias("tier"), F.when(F.col("l_tax") > 0.04, "static").otherwise("runtime").alias("method"), F.array("l_orderkey").alias("evidence_ids"),
    )
    x = op.links_of_claims(c)
    return x.withColumn("methods", F.array_join("methods", ",")).withColumn("evidence_ids", F.array_join(F.col("evidence_ids").cast("array<string>"), ","))


@query("""
WITH e AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY 1), o AS (SELECT DISTINCT o_custkey AS claim_id, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
c AS (SELECT claim_id, list(p) AS ids FROM o GROUP BY 1)
SELECT e.id, c.claim_id FROM e JOIN o ON o.p = e.ids[1] JOIN c ON c.claim_id = o.claim_id WHERE list_has_all(c.ids, e.ids)
""")
def backed_edges(spark, d):
    """Orders and the customers who bought all of their parts."""
    li, o = load(spark, d, "lineitem").select("l_orderkey", "l_partkey"), load(spark, d, "orders").select("o_orderkey", "o_custkey")
    e = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("evidence_ids"))
    c = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("claim_id")).agg(F.collect_set("l_partkey").alias("evidence_ids"))
    return op.backed_edges(e, c)


@query("""
WITH s AS (SELECT c_custkey FROM customer WHERE c_nationkey < 5), l AS (SELECT DISTINCT a.o_custkey AS f, b.o_custkey AS t FROM orders a JOIN orders b ON a.o_orderkey + 1 = b.o_orderkey)
SELECT f AS from_key, t AS to_key FROM l WHERE f IN (FROM s) AND t IN (FROM s)
""")
def induced_map(spark, d):
    """Links between the customers of some nations, both ends inside."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("to_key"))
    pairs = o.join(nxt, "o_orderkey").select(F.col("o_custkey").alias("from_key"), "to_key").distinct()
    scope = load(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("key"))
    return op.induced(o.select(F.col("o_custkey").alias("key")), pairs, scope, "key")[1]


_TEMPLATE = r"""t AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, '/' || CASE WHEN s_suppkey % 4 = 0 THEN '{param}' ELSE 'api' || s_nationkey END || '/' || CASE WHEN s_suppkey % 5 = 0 THEN '{param}' ELSE 'v' || (s_suppkey % 7) END AS path FROM supplier)"""


@query(rf"""
WITH {_TEMPLATE}, s AS (SELECT *, string_split(substr(path, 2), '/') AS s FROM t)
SELECT a.id AS a, b.id AS b, CASE WHEN a.path = b.path THEN 'exact' ELSE 'candidate' END AS kind FROM s a JOIN s b ON a.id < b.id AND a.method = b.method
  AND (a.s[1] = b.s[1] OR '{{param}}' IN (a.s[1], b.s[1])) AND (a.s[2] = b.s[2] OR '{{param}}' IN (a.s[2], b.s[2]))
""")
def template_overlap(spark, d):
    """Pairs of endpoint templates that are equal or that some path fits both."""
    k = F.col("s_suppkey")
    method = F.element_at(F.array(F.lit("GET"), F.lit("POST"), F.lit("PUT")), (k % 3 + 1).cast("int"))
    path = F.concat(F.lit("/"), F.when(k % 4 == 0, "{param}").otherwise(F.concat(F.lit("api"), "s_nationkey")), F.lit("/"), F.when(k % 5 == 0, "{param}").otherwise(F.concat(F.lit("v"), k % 7)))
    return op.template_overlap(load(spark, d, "supplier").select(k.alias("id"), method.alias("method"), path.alias("path")))


@query()
def page_owners(spark, d):
    """Pages accepted in order: dropped where an accepted one before has the address or the content (tested against a loop)."""
    p = load(spark, d, "pages").select("page_id", tx.canonical_url(F.coalesce("url", F.lit(""))).alias("uri"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("content"))
    return op.first_owners(p, "page_id", ["uri", "content"])


#: Paths that the label queries give to parts in turn.
SAMPLE = (
    "src/App.tsx", "src/user.client.ts", "app/Http/Controller.php", "config/app.yaml", "database/migrations/001.sql", "package-lock.json", "dist/main.min.js",
    "docs/guide.md", "openapi.json", "routes/web.php", ".github/workflows/ci.yml", "assets/logo.png", "src/types.d.ts", "swagger-v2.yaml", "README", "tsconfig.base.json",
)


def _paths(spark, d):
    """Parts with a path, and whether it is binary."""
    path = F.element_at(F.array(*[F.lit(x) for x in SAMPLE]), (F.col("p_partkey") % len(SAMPLE) + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", "p_name", "p_size", path.alias("path")).withColumn("binary", F.col("path").endswith(".png"))


_PATHS = "f AS (SELECT p_partkey, p_name, p_size, path, lower(path) AS low, regexp_extract(lower(path), '([^/]*)$', 1) AS name, path LIKE '%.png' AS bin, regexp_matches(path, '\\.(tsx?|php)$') AS lang FROM (SELECT *, [" + ", ".join(f"'{x}'" for x in SAMPLE) + f"][p_partkey % {len(SAMPLE)} + 1] AS path FROM part))"
_IN = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_LABELS = f"""list_sort(list_filter([CASE WHEN lang THEN 'source' END, CASE WHEN name IN {_IN(rules.CONFIGURATION)} OR regexp_matches(low, '{rules.PATHS["configuration"]}') THEN 'configuration' END,
  CASE WHEN regexp_matches(low, '{rules.PATHS["schema"]}') THEN 'schema' END, CASE WHEN name IN {_IN(rules.LOCKFILES)} THEN 'lockfile' END, CASE WHEN regexp_matches(low, '{rules.PATHS["generated"]}') THEN 'generated' END,
  CASE WHEN bin THEN 'binary' END, CASE WHEN NOT lang THEN 'unsupported' END], lambda x: x IS NOT NULL))"""


@query(f"""
WITH {_PATHS} SELECT p_partkey, array_to_string({_LABELS}, ',') AS labels, array_to_string(list_sort(list_filter([CASE WHEN name IN {_IN(rules.LOCKFILES)} THEN 'lockfile' END,
  CASE WHEN regexp_matches(low, '{rules.PATHS["generated"]}') THEN 'generated_file' END, CASE WHEN bin THEN 'binary_file' END, CASE WHEN NOT lang THEN 'unsupported_language' END, CASE WHEN p_size < 5 THEN 'patch_unavailable' END,
  CASE WHEN p_size % 7 = 0 AND NOT bin AND p_size >= 5 AND p_partkey % 3 = 0 THEN 'no_changed_ranges' END, CASE WHEN p_size = 50 THEN 'copied_file' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM f
""")
def changed_file_labels(spark, d):
    """All labels of changed files, and why parts of them are not mapped."""
    x, size = _paths(spark, d), F.col("p_size")
    operation = F.when(F.col("p_partkey") % 3 == 0, "modified").otherwise("added")
    reasons = rules.file_reasons(F.col("path"), F.col("binary"), size >= 5, size % 7, operation, size == 50)
    return x.select("p_partkey", F.array_join(rules.file_labels(F.col("path"), F.col("binary")), ",").alias("labels"), F.array_join(reasons, ",").alias("reasons"))


@query(f"""
WITH {_PATHS} SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(path, '{rules.REFRESH["documentation"]}') THEN 'documentation' END, CASE WHEN regexp_matches(path, '{rules.REFRESH["openapi"]}') THEN 'openapi' END,
  CASE WHEN regexp_matches(path, '{rules.REFRESH["configuration"]}') OR list_has_any({_LABELS}, ['configuration', 'schema']) THEN 'configuration' END, CASE WHEN regexp_matches(path, '\\.tsx?$') THEN 'typescript' END,
  CASE WHEN path LIKE '%.php' THEN 'php' END], lambda x: x IS NOT NULL), ',') AS kinds FROM f
""")
def refresh_kinds(spark, d):
    """Which parts of the knowledge a changed path concerns."""
    x = _paths(spark, d)
    return x.select("p_partkey", F.array_join(rules.refresh_kinds(F.col("path"), rules.file_labels(F.col("path"), F.col("binary"))), ",").alias("kinds"))


_NAMED = "CASE p_size % 5 WHEN 0 THEN 'handle' || upper(left(p_name, 1)) WHEN 1 THEN 'Widget' || p_size WHEN 2 THEN 'userApi' WHEN 3 THEN 'on' ELSE 'plain' END"


@query(f"""
WITH {_PATHS}, s AS (SELECT *, {_NAMED} AS sym, p_size % 11 = 0 AS cls, p_size % 3 = 0 AS mem, p_size % 2 = 0 AS obj, p_partkey % 2 = 0 AS jsx FROM f)
SELECT p_partkey, CASE WHEN cls THEN 'class' WHEN regexp_matches(sym, '^(handle|on)[A-Z]') THEN 'handler' WHEN path LIKE '%.tsx' AND regexp_matches(sym, '^[A-Z][A-Za-z0-9]*$') AND jsx THEN 'component' WHEN mem THEN 'method'
  WHEN obj AND (regexp_matches(path, '\\.client\\.tsx?$') OR regexp_matches(sym, '(Client|Api|API)$')) THEN 'service' WHEN obj THEN 'module' ELSE 'function' END AS kind FROM s
""")
def symbol_kinds(spark, d):
    """The kind of each symbol by the first rule that holds."""
    size = F.col("p_size")
    name = F.when(size % 5 == 0, F.concat(F.lit("handle"), F.upper(F.left("p_name", F.lit(1))))).when(size % 5 == 1, F.concat(F.lit("Widget"), size)).when(size % 5 == 2, "userApi").when(size % 5 == 3, "on").otherwise("plain")
    return _paths(spark, d).select("p_partkey", rules.symbol_kind(name, F.col("path"), size % 11 == 0, size % 3 == 0, size % 2 == 0, F.col("p_partkey") % 2 == 0).alias("kind"))


#: Names of actions that the policy query gives to events in turn.
ACTIONS = ("View details", "Delete account", "Pay now", "Invite admin", "Send message", "Save", "Refresh page", "Load more results page", "Next", "Expand", "open menu", "")
_SQL_ACTION = "[" + ", ".join(f"'{x}'" for x in ACTIONS) + f"][event_id % {len(ACTIONS)} + 1]"


@query(f"""
WITH a AS (SELECT event_id, {_SQL_ACTION} AS name, ['click', 'fill', 'navigate', 'reload', 'check'][event_id % 5 + 1] AS kind, event_type, value FROM events),
c AS (SELECT event_id, CASE WHEN value > 98 THEN 'download' WHEN value > 96 THEN 'popup' WHEN value > 94 THEN 'external_navigation' WHEN kind IN ('fill', 'select') THEN CASE WHEN event_type = 'signup' THEN 'credential_entry' ELSE 'unknown_submission' END
  {" ".join(f"WHEN regexp_matches(name, '{p}') THEN '{c}'" for c, p in rules.UNSAFE)} WHEN event_type = 'purchase' THEN 'unknown_submission' WHEN kind IN ('navigate', 'back') THEN 'safe_navigation' WHEN kind = 'reload' THEN 'safe_read'
  WHEN kind = 'check' THEN 'safe_form_progress' WHEN regexp_matches(name, '{rules.SAFE_READ}') THEN 'safe_read' ELSE 'unknown_submission' END AS category FROM a)
SELECT event_id, category, category IN {_IN(rules.SAFE)} AS allowed FROM c
""")
def action_policy(spark, d):
    """The category of browser actions, and whether they may run."""
    e, n = load(spark, d, "events"), F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ACTIONS]), (n % len(ACTIONS) + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("click", "fill", "navigate", "reload", "check")]), (n % 5 + 1).cast("int"))
    v, t = F.col("value"), F.col("event_type")
    c = rules.action_category(kind, name, t == "purchase", v > 94, v > 98, v > 96, F.when(t == "signup", "password"))
    x = e.select("event_id", c.alias("category"))
    return x.withColumn("allowed", F.col("category").isin(*rules.SAFE))


def _redacted(c: str, patterns) -> str:
    for p, to in patterns:
        c = "regexp_replace({}, '{}', '{}', 'g')".format(c, p, to.replace("$1", r"\1"))
    return c


@query(f"""
WITH r AS (SELECT doc_id, trim(regexp_replace({_redacted("coalesce(text, '')", [*tx.SECRETS, *rules.PERSONAL])}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS r FROM documents)
SELECT doc_id, sha256(CASE WHEN r = '' THEN '[EMPTY]' WHEN length(r) <= 4096 THEN r ELSE left(r, 4085) || '[TRUNCATED]' END) AS observed_sha256, length(r) > 4096 AS truncated FROM r
""")
def observed_text(spark, d):
    """Documents as observed text: without secrets and personal data, collapsed, and cut with a mark (a digest of it)."""
    x = load(spark, d, "documents").select("doc_id", rules.redact_observed(F.coalesce("text", F.lit(""))).alias("r"))
    return x.select("doc_id", F.sha2(F.col("r").cast("binary"), 256).alias("observed_sha256"), F.col("r").endswith("[TRUNCATED]").alias("truncated"))


@query(f"""
WITH u AS (SELECT page_id, 'fetch of ' || regexp_replace(url, '^([a-z]+://)', '\\1user' || page_id || ':pw@') || ' failed; token: abc' || page_id AS m FROM pages),
r AS (SELECT page_id, trim({_redacted(_redacted("m", [(r"(?i)\b(https?://)[^\s/@]+@", "$1[REDACTED]@")]), tx.SECRETS)}) AS r FROM u)
SELECT page_id, left(CASE WHEN r = '' THEN 'Source connector operation failed' ELSE r END, 2048) AS message FROM r
""")
def connector_messages(spark, d):
    """A connector's messages without credentials in addresses and labelled secrets."""
    u = F.regexp_replace(F.col("url"), "^([a-z]+://)", "$1user:pw@")
    u = F.replace(u, F.lit("user:pw@"), F.concat(F.lit("user"), "page_id", F.lit(":pw@")))
    m = F.concat(F.lit("fetch of "), u, F.lit(" failed; token: abc"), "page_id")
    return load(spark, d, "pages").select("page_id", rules.redact_connector(m).alias("message"))


_OPTIONAL = "'/shop/' || s_nationkey || CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/{a?}' WHEN 2 THEN '/{a?}/{b?}' ELSE '/{a?}/{b?}/{c?}' END"


@query(f"""
WITH r AS (SELECT s_suppkey, {_OPTIONAL} AS path, CASE WHEN s_suppkey % 3 = 0 THEN ['ANY'] ELSE ['GET', 'POST'] END AS methods FROM supplier),
s AS (SELECT s_suppkey, methods, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM r), n AS (SELECT *, len(list_filter(s, lambda x: x LIKE '%?}}')) AS n FROM s),
v AS (SELECT s_suppkey, methods, '/' || array_to_string(list_transform(s[1 : len(s) - n + k], lambda x: replace(x, '?}}', '}}')), '/') AS path FROM n, unnest(range(0, n + 1)) t(k))
SELECT s_suppkey, unnest(CASE WHEN methods = ['ANY'] THEN [{", ".join(f"'{m}'" for m in rules.METHODS)}] ELSE methods END) AS method, path FROM v
""")
def route_endpoints(spark, d):
    """Endpoints of routes: each method (ANY: all seven) with each number of optional segments."""
    k = F.col("s_suppkey")
    path = F.concat(F.lit("/shop/"), "s_nationkey", F.element_at(F.array(*[F.lit(x) for x in ("", "/{a?}", "/{a?}/{b?}", "/{a?}/{b?}/{c?}")]), (k % 4 + 1).cast("int")))
    methods = F.when(k % 3 == 0, F.array(*[F.lit(m) for m in rules.METHODS])).otherwise(F.array(F.lit("GET"), F.lit("POST")))
    x = load(spark, d, "supplier").select("s_suppkey", methods.alias("m"), F.explode(rules.optional_paths(path)).alias("path"))
    return x.select("s_suppkey", F.explode("m").alias("method"), "path")


@query(r"""
WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\t\f\x0B ]+', ' ', 'g'))) AS l FROM documents),
t AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS t FROM l)
SELECT doc_id, sha256(t) AS text_sha256, left(CASE WHEN t = '' THEN 'Documentation' ELSE t END, 512) AS heading FROM t
""")
def evidence_texts(spark, d):
    """Documents as evidence text (a digest of it), and their bounded headings."""
    x = load(spark, d, "documents").select("doc_id", rules.evidence_text(F.coalesce("text", F.lit(""))).alias("t"))
    return x.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), F.left(F.when(F.col("t") == "", "Documentation").otherwise(F.col("t")), F.lit(512)).alias("heading"))
