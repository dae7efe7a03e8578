"""Queries that read documents of other formats; the documents are written from the tables, so SQL can check what is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import rules as rl
from strandline.operators import policy
from strandline.plans.registry import load, query
from strandline.sources import api_documents, diffs, html


def _patches(spark, d):
    """A patch by order: returned lines are removed, accepted ones added, the rest context."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    mark = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(" ")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", mark.alias("mark"))  # text is put together afterwards, so groups stay small
    by = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    text = lambda r: F.concat(r["mark"], F.concat_ws(" ", r["l_linenumber"], r["l_partkey"], r["l_suppkey"]))
    key = F.col("l_orderkey").cast("string")
    head = F.concat(F.lit("diff --git a/o"), key, F.lit(".txt b/o"), key, F.lit(".txt\n--- a/o"), key, F.lit(".txt\n+++ b/o"), key, F.lit(".txt\n@@ -5,9 +7,9 @@\n"))
    return by.select(key.alias("pr_id"), F.concat(head, F.array_join(F.transform("rows", text), "\n")).alias("patch"))


@query("""
WITH n AS (SELECT *, count(*) FILTER (l_returnflag <> 'A') OVER w AS b, count(*) FILTER (l_returnflag <> 'R') OVER w AS h FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey::VARCHAR AS pr_id, CASE l_returnflag WHEN 'R' THEN 'base' ELSE 'head' END AS side, CASE l_returnflag WHEN 'R' THEN 4 + b ELSE 6 + h END::BIGINT AS line,
  concat_ws(' ', l_linenumber, l_partkey, l_suppkey) AS content FROM n WHERE l_returnflag IN ('A', 'R')
""")
def git_diff_parse(spark, d):
    """Changed lines of patches with the line numbers of their side."""
    return diffs.diff_lines(_patches(spark, d)).select("pr_id", "side", F.col("line").cast("bigint").alias("line"), "content")


@query("""
SELECT n_name AS application_id, 'GET' AS method, '/api/suppliers/{param}/s' || s_suppkey AS path, 'read' || s_suppkey AS operation_id, n_name || ',' || (s_suppkey % 3) AS tags FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT n_name, 'DELETE', '/api/suppliers/{param}/s' || s_suppkey, 'drop' || s_suppkey, '' FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def openapi_endpoints(spark, d):
    """Endpoints of API documents: a document by nation, a path by supplier."""
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    op = lambda name, tags: F.struct(F.concat(F.lit(name), "s_suppkey").alias("operationId"), *tags)
    tags = F.array("n_name", (F.col("s_suppkey") % 3).cast("string")).alias("tags")
    path = F.struct(F.concat(F.lit("/suppliers/{id}/s"), "s_suppkey").alias("key"), F.struct(op("read", [tags]).alias("get"), op("drop", []).alias("delete"), F.lit("x").alias("summary")).alias("value"))
    docs = s.groupBy("n_name").agg(F.map_from_entries(F.collect_list(path)).alias("paths"))
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("https://host.example/api/").alias("url"))).alias("servers"), "paths"))
    e = api_documents.endpoints(docs.select(F.col("n_name").alias("application_id"), doc.alias("document")))
    return e.withColumn("tags", F.array_join("tags", ","))


@query("""
SELECT o_orderkey::VARCHAR AS delivery_id, CASE WHEN o_orderstatus = 'P' THEN 'ignored_event' WHEN o_orderpriority = '5-LOW' THEN 'ignored_action' WHEN o_orderkey % 10 = 0 THEN 'malformed' WHEN o_orderkey % 4 = 0 THEN 'ignored_draft' ELSE 'accepted' END AS decision,
  o_custkey AS number, CASE WHEN o_orderkey % 10 = 0 THEN 'short' ELSE substr(sha256(o_orderkey::VARCHAR), 1, 40) END AS head FROM orders
""")
def webhook_decisions(spark, d):
    """Deliveries as JSON: accepted, or the first reason to ignore them."""
    o, key = load(spark, d, "orders"), F.col("o_orderkey").cast("string")
    sha = F.when(F.col("o_orderkey") % 10 == 0, "short").otherwise(F.left(F.sha2(key.cast("binary"), 256), F.lit(40)))
    pull = F.struct(F.col("o_custkey").alias("number"), (F.col("o_orderkey") % 4 == 0).alias("draft"), F.struct(sha.alias("sha")).alias("head"))
    body = F.to_json(F.struct(F.when(F.col("o_orderpriority") == "5-LOW", "closed").otherwise("opened").alias("action"), pull.alias("pull_request")))
    return api_documents.decisions(o.select(key.alias("delivery_id"), F.when(F.col("o_orderstatus") == "P", "push").otherwise("pull_request").alias("event"), body.alias("payload")))


@query("""
WITH p AS (SELECT 'd' || doc_id || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.md' ELSE '/README.md' END AS path FROM documents),
l AS (SELECT doc_id AS from_page, 'd' || (doc_id * 5 + 1) AS target FROM documents)
SELECT DISTINCT from_page, target, coalesce((SELECT path FROM p WHERE path = target), (SELECT path FROM p WHERE path = target || '.md'), (SELECT path FROM p WHERE path = target || '/README.md')) AS to_page FROM l
""")
def repository_links(spark, d):
    """Relative links resolved to the first file that exists."""
    x = load(spark, d, "documents").select("doc_id").distinct()
    end = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, ".md").otherwise("/README.md")
    pages = x.select(F.concat(F.lit("d"), "doc_id", end).alias("path"))
    links = x.select(F.col("doc_id").alias("from_page"), F.concat(F.lit("d"), F.col("doc_id") * 5 + 1).alias("target"))
    return html.resolve_links(links, pages).select("from_page", "target", "to_page")


def _file_patches(spark, d):
    """A customer's orders as the files of a patch: new, renamed or deleted by status, urgent ones binary, the rest with a hunk."""
    lit = F.lit

    def text(o):
        k = o["o_orderkey"].cast("string")
        name = F.concat(lit("src/o"), k, lit(".ts"))
        to = F.when(o["o_orderstatus"] == "O", F.concat(lit("lib/o"), k, lit(".ts"))).otherwise(name)
        head = F.concat(lit("diff --git a/"), name, lit(" b/"), to, lit("\n"))
        how = F.when(o["o_orderstatus"] == "F", "new file mode 100644\n").when(o["o_orderstatus"] == "P", "deleted file mode 100644\n")
        how = how.otherwise(F.concat(lit("similarity index 9"), F.substring(k, -1, 1), lit("%\nrename from "), name, lit("\nrename to "), to, lit("\n")))
        body = F.when(o["o_orderpriority"] == "1-URGENT", F.concat(lit("Binary files a/"), name, lit(" and b/"), to, lit(" differ\n"))).otherwise(lit("@@ -3,2 +3,3 @@\n same\n-rename from nowhere\n+new file mode\n+diff\n"))
        return F.concat(head, how, body)

    files = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")))  # text is put together afterwards, so groups stay small
    by = load(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("pr_id")).agg(files.alias("files"))
    return by.select("pr_id", F.array_join(F.transform("files", text), "").alias("patch"))


@query("""
WITH o AS (SELECT *, o_orderkey::VARCHAR AS k FROM orders)
SELECT o_custkey::VARCHAR AS pr_id, CASE o_orderstatus WHEN 'F' THEN 'added' WHEN 'P' THEN 'deleted' ELSE 'renamed' END AS operation, CASE WHEN o_orderstatus <> 'F' THEN 'src/o' || k || '.ts' END AS old_path,
  CASE o_orderstatus WHEN 'F' THEN 'src/o' || k || '.ts' WHEN 'O' THEN 'lib/o' || k || '.ts' END AS new_path, CASE WHEN o_orderstatus = 'O' THEN 90 + (o_orderkey % 10)::INTEGER END AS similarity, o_orderpriority = '1-URGENT' AS "binary" FROM o
""")
def changed_files(spark, d):
    """The files of patches with their operation, paths, similarity and whether they are binary."""
    return diffs.diff_files(_file_patches(spark, d)).drop("file")


@query("""
WITH o AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'), n AS (SELECT o_custkey::VARCHAR AS pr_id FROM o)
SELECT pr_id, 'base' AS side, 4 AS first, 4 AS last, count(*) AS n FROM n GROUP BY pr_id UNION ALL SELECT pr_id, 'head', 4, 5, count(*) FROM n GROUP BY pr_id
""")
def changed_ranges(spark, d):
    """Runs of changed lines of patches, counted by patch, side and place."""
    x = diffs.diff_ranges(diffs.diff_lines(_file_patches(spark, d)))
    return x.groupBy("pr_id", "side", "first", "last").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT DISTINCT p_name AS package, p_size AS version, p_brand AS license FROM part)
SELECT * FROM p WHERE license NOT IN ('Brand#1', 'Brand#2', 'Brand#3') AND NOT (license = 'Brand#4' AND version < 40)
""")
def license_breaches(spark, d):
    """Parts as packages whose brand is no allowed licence; those of one brand are excused below a version, others no longer."""
    p = load(spark, d, "part").select(F.col("p_name").alias("package"), F.col("p_size").alias("version"), F.col("p_brand").alias("license"))
    allowed = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",)], "license string")
    until = F.when(F.col("license") == "Brand#4", "2026-06-01").otherwise("2026-05-31")
    excused = p.where("license in ('Brand#4', 'Brand#5') and version < 40").distinct().withColumn("expires_on", until)
    return policy.license_violations(p, allowed, excused, "2026-06-01")


@query("""
SELECT DISTINCT 'A-' || o_orderstatus || o_orderpriority[1] AS advisory, 'c' || o_custkey AS package, CASE o_orderpriority[1] WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'moderate' ELSE 'low' END AS severity
FROM orders WHERE o_orderpriority[1] IN ('1', '2') OR o_orderstatus <> 'F'
""")
def dependency_breaches(spark, d):
    """Advisories about customers as packages: grave ones all, the rest unless their status is excused (exceptions for grave ones do not count)."""
    k = F.substring("o_orderpriority", 1, 1)
    a = load(spark, d, "orders").select(F.concat(F.lit("A-"), "o_orderstatus", k).alias("advisory"), F.concat(F.lit("c"), "o_custkey").alias("package"), F.when(k == "1", "critical").when(k == "2", "high").when(k == "3", "moderate").otherwise("low").alias("severity"), "o_orderstatus")
    excused = a.where("o_orderstatus = 'F'").drop("o_orderstatus").distinct().withColumn("expires_on", F.lit("2030-01-01"))
    return policy.dependency_violations(a, excused, "2026-06-01")


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS k, CASE o_orderpriority[1] WHEN '1' THEN 'orders' WHEN '2' THEN 'Token' WHEN '3' THEN 'a b' WHEN '4' THEN 'mail' ELSE '' END AS label FROM orders)
SELECT o_orderkey, 'https://shop.example:8080/' || CASE label WHEN 'a b' THEN 'a%20b' ELSE label END || '/' || CASE label WHEN 'Token' THEN 'redacted' WHEN 'mail' THEN 'redacted' WHEN 'a b' THEN 'v' || k WHEN '' THEN 'redacted' ELSE 'redacted' END || '/end' AS url FROM o
""")
def redacted_addresses(spark, d):
    """Addresses of orders without user, query and fragment, and without what is secret or personal in their paths."""
    k, p = F.col("o_orderkey").cast("string"), F.substring("o_orderpriority", 1, 1)
    label = F.when(p == "1", "orders").when(p == "2", "Token").when(p == "3", "a%20b").when(p == "4", "mail").otherwise("")
    value = F.when(p == "1", k).when(p == "2", "x").when(p == "3", F.concat(F.lit("v"), k)).when(p == "4", F.concat(F.lit("me"), k, F.lit("%40x.org"))).otherwise(F.concat(F.lit("own-secret-"), k))
    url = F.concat(F.lit("HTTPS://user:pw@Shop.example:8080/"), label, F.lit("/"), value, F.lit("/end?q=1#top"))
    return load(spark, d, "orders").select("o_orderkey", rl.redact_url(url, F.array(F.lit("own-secret"), F.lit(""))).alias("url"))
