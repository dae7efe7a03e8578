"""Queries over source slices, listings, roles, run control and report records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import records as op
from strandline.plans.registry import load, query


@query(r"""
WITH l AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10))[2:6] AS l FROM documents),
n AS (SELECT doc_id, i, l[i] AS s, sum(strlen(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l, unnest(range(1, len(l) + 1)) t(i))
SELECT d.doc_id, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (upto <= 400), '') AS slice, coalesce(bool_or(upto > 400), false) AS truncated FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
""")
def source_slices(spark, d):
    """Lines two to six of each document, whole lines within four hundred bytes (a slice's bound), and whether some were left out."""
    return op.line_slice(load(spark, d, "documents"), "doc_id", "text", 2, 6, 400)


@query("SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL ORDER BY path LIMIT 100000")
def indexed_paths(spark, d):
    """All paths of pages in order, at most a hundred thousand (a listing's limit)."""
    p = load(spark, d, "pages").where("url is not null").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    return p.distinct().orderBy("path").limit(100_000)


@query("""
WITH e AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 9 = 0 THEN 'tree' WHEN p_size % 11 = 0 THEN 'commit' ELSE 'blob' END AS kind, (p_size * 1000)::BIGINT AS size, 'src/' || replace(p_name, ' ', '/') || '/' || p_partkey AS path FROM part)
SELECT p_brand, count(*) FILTER (kind = 'blob') AS files, coalesce(sum(size) FILTER (kind = 'blob'), 0)::BIGINT AS bytes, max(len(string_split(path, '/')))::INTEGER AS depth, count(*) FILTER (kind = 'commit') AS submodules,
  CASE WHEN count(*) FILTER (kind = 'commit') > 3 THEN 'submodules' WHEN coalesce(sum(size) FILTER (kind = 'blob'), 0) > 1500000 THEN 'too_large' ELSE 'accepted' END AS preflight FROM e GROUP BY p_brand
""")
def tree_preflight(spark, d):
    """Listings of trees parsed, and whether they are within the limits of a checkout."""
    kind = F.when(F.col("p_size") % 9 == 0, "tree").when(F.col("p_size") % 11 == 0, "commit").otherwise("blob")
    path = F.concat(F.lit("src/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit("/"), "p_partkey")
    line = F.format_string("100644 %s %s %7d\t%s", kind, F.sha1(F.col("p_partkey").cast("string").cast("binary")), F.col("p_size") * 1000, path)
    listing = load(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(line), "\0").alias("listing"))
    return op.preflight(op.tree_entries(listing, "p_brand", "listing"), "p_brand", 3, 1_500_000)


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 60 DAY AS e FROM orders)
SELECT l_orderkey, l_linenumber, l_partkey, min(w.o_orderkey) AS symbol FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey JOIN w ON w.o_custkey = o.o_custkey AND l_shipdate BETWEEN w.s AND w.e WHERE l_returnflag = 'R' GROUP BY ALL
""")
def test_hits(spark, d):
    """Hits in tests with the first symbol in order of the list that holds them, not the innermost."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    hits = load(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    w = o.select("o_custkey", F.col("o_orderkey").alias("symbol"), F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("e"))
    return op.first_holder(hits, w, "o_custkey", "l_shipdate", "s", "e", "symbol", ["l_orderkey", "l_linenumber", "l_partkey"], 60)


@query("""
WITH r AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'controller' WHEN p_size < 10 THEN 'model' END AS role FROM part),
e AS (SELECT DISTINCT l_suppkey AS from_id, CASE l_returnflag WHEN 'A' THEN 'uses' WHEN 'N' THEN 'extends' ELSE 'mentions' END AS type, l_partkey AS to_id FROM lineitem)
SELECT from_id, type, to_id FROM e UNION ALL SELECT from_id, 'has_' || role, to_id FROM e JOIN r ON p_partkey = to_id WHERE role IS NOT NULL AND type <> 'mentions'
""")
def role_edges(spark, d):
    """Typed relationships, and those to targets with a role once more as edges of the role."""
    role = F.when(F.col("p_type") == "PROMO", "controller").when(F.col("p_size") < 10, "model")
    roles = load(spark, d, "part").select(F.col("p_partkey").alias("to_id"), role.alias("role"))
    f = F.col("l_returnflag")
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_id"), F.when(f == "A", "uses").when(f == "N", "extends").otherwise("mentions").alias("type"), F.col("l_partkey").alias("to_id")).distinct()
    return op.with_role_edges(e, roles, ["uses", "extends"])


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'paused' ELSE 'failed' END AS status, ['cancel', 'retry', 'pause', 'resume'][o_orderkey % 4 + 1] AS action FROM orders)
SELECT o_orderkey, action, CASE WHEN action = 'cancel' AND status IN ('running', 'paused') THEN 'cancelled' WHEN action = 'retry' AND status = 'failed' THEN 'queued' WHEN action = 'pause' AND status = 'running' THEN 'paused'
  WHEN action = 'resume' AND status = 'paused' THEN 'running' ELSE 'rejected' END AS outcome, CASE WHEN action = 'pause' THEN count(*) FILTER (action = 'pause') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS decision FROM r
""")
def run_control(spark, d):
    """Requests to cancel, retry, pause and resume runs: the new status where it is allowed, and the number of a pause's decision."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "paused").otherwise("failed")
    action = F.element_at(F.array(*[F.lit(x) for x in ("cancel", "retry", "pause", "resume")]), (k % 4 + 1).cast("int"))
    r = load(spark, d, "orders").select("o_orderkey", "o_custkey", status.alias("status"), action.alias("action"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    x = op.control(r, "status", "action").withColumn("decision", F.when(F.col("action") == "pause", F.count_if(F.col("action") == "pause").over(w)))
    return x.select("o_orderkey", "action", "outcome", "decision")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus AS payload, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k, first_value(o_orderstatus) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS first,
  max(o_orderdate) OVER (PARTITION BY o_custkey) AS head FROM orders)
SELECT o_orderkey, CASE WHEN k > 1 AND payload = first THEN 'existing' WHEN k > 1 THEN 'conflict' WHEN o_orderdate < head THEN 'superseded' ELSE 'published' END AS disposition FROM r
""")
def report_dispositions(spark, d):
    """What becomes of finished reports: published, superseded by a newer head, there already, or in conflict with what is there."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    return op.dispositions(o, ["o_custkey", "o_orderpriority"], "o_custkey", ["o_orderkey"], "o_orderdate", "o_orderstatus").select("o_orderkey", "disposition")


#: Predicates that a kind of evidence supports, in the predicate query.
SUPPORTS = (("A", "calls"), ("A", "handles"), ("N", "renders"), ("R", "tests"), ("R", "calls"))


@query(f"""
WITH s(kind, predicate) AS (VALUES {", ".join(str(x) for x in SUPPORTS)}), e AS (SELECT l_orderkey, l_returnflag AS kind, CASE WHEN l_tax < 0.03 THEN 'calls' WHEN l_tax < 0.05 THEN 'handles' WHEN l_tax < 0.07 THEN 'renders' ELSE 'tests' END AS predicate FROM lineitem)
SELECT predicate, kind, count(*) AS claims, (kind, predicate) IN (FROM s) AS supported FROM e GROUP BY 1, 2
""")
def predicate_support(spark, d):
    """Claims by predicate and kind of evidence, and whether the kind supports the predicate."""
    t = F.col("l_tax")
    predicate = F.when(t < 0.03, "calls").when(t < 0.05, "handles").when(t < 0.07, "renders").otherwise("tests")
    g = load(spark, d, "lineitem").groupBy(predicate.alias("predicate"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("claims"))
    s = spark.createDataFrame(list(SUPPORTS), "kind string, predicate string").withColumn("_s", F.lit(True))
    return g.join(s, ["kind", "predicate"], "left").select("predicate", "kind", "claims", F.coalesce("_s", F.lit(False)).alias("supported"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, min(s_suppkey) AS handler FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey AND p_size > 25
  JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1, 2, 3
""")
def complete_evidence(spark, d):
    """Steps that lead over their flow and actor to a handler; the first handler that matches counts."""
    first = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("handler"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(first, "c_nationkey")
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    p = load(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    x = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey", "left_semi").join(o, "l_orderkey")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "handler").distinct()


@query("""
WITH h AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS mapped, c_nationkey AS workflow FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0)
SELECT id, CASE WHEN NOT mapped THEN 'unknown' WHEN workflow IS NULL THEN 'static' ELSE 'dynamic' END AS kind, CASE WHEN mapped THEN workflow END AS workflow FROM h
""")
def impact_hypotheses(spark, d):
    """Mapped hypotheses with their workflows, and what stays unknown."""
    c = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("workflow"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus")
    mapped = o.where("o_orderstatus <> 'P'").join(c, "o_custkey", "left").select("id", F.when(F.col("workflow").isNull(), "static").otherwise("dynamic").alias("kind"), "workflow")
    return mapped.unionByName(o.where("o_orderstatus = 'P'").select("id", F.lit("unknown").alias("kind"), F.lit(None).cast("int").alias("workflow")))


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS waited FROM events
""")
def run_timeline(spark, d):
    """The events of each user in order, with the whole seconds since the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp"))
    e = load(spark, d, "events").select("user_id", "event_id", "ts", second.alias("s"))
    return e.select("user_id", "event_id", F.row_number().over(w).cast("bigint").alias("place"), (F.col("s") - F.lag("s").over(w)).alias("waited"))


@query("""
WITH m AS (SELECT 'd' || doc_id AS id, doc_id, CASE WHEN lang IS NULL THEN 'unknown' ELSE lang END AS lang, length(coalesce(text, '')) AS n FROM documents), c AS (SELECT *, sum(n) OVER (ORDER BY doc_id) AS upto FROM m)
SELECT id, lang, n::BIGINT AS n FROM c WHERE upto <= 200000
""")
def documentation_budget(spark, d):
    """The first documents in order that fit into a budget of characters (the reader's page budget)."""
    x = load(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    return op.within_total(x, ["doc_id"], "n", 200_000).select("id", "lang", "n")


@query(r"""
WITH s AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w, text FROM benchmark)
SELECT item_id, len(w)::INTEGER AS words, regexp_matches(lower(text), '\b(not|never|no|cannot|must not)\b') AS negative, regexp_matches(lower(text), '\b(must|shall|should|required)\b') AS required FROM s
""")
def statement_polarity(spark, d):
    """The polarity of statements by their words."""
    t = F.lower("text")
    return load(spark, d, "benchmark").select("item_id", F.size(tx.words(F.col("text"))).alias("words"), t.rlike(r"\b(not|never|no|cannot|must not)\b").alias("negative"), t.rlike(r"\b(must|shall|should|required)\b").alias("required"))
