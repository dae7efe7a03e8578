"""Records and files from outside, made of the given tables: an indexer's outputs, excerpts, stored artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.tables import shared_dir
from strandline.operators.rows import as_of
from strandline.plans.registry import load, query
from strandline.sources import api_references, ingest as op


def _outputs(spark, d):
    """A customer's orders as an indexer's output: orders are symbols (of status P without a name, low ones as bare text), those of high
    priority end before they start; of customers in debt by more than 900 the JSON is cut short."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    k = F.col("o_orderkey").cast("string")
    symbol = F.to_json(F.struct(k.alias("id"), F.lit("a.php").alias("file_path"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("C\\"), k)).alias("qualified_name"), F.lit("class").alias("kind"), F.lit(7).alias("start_line"), F.when(F.col("o_orderpriority") == "2-HIGH", 3).otherwise(9).alias("end_line")))
    element = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit('"'), k, F.lit('"'))).otherwise(symbol)
    by = o.groupBy("o_custkey").agg(F.concat(F.lit('{"symbols":['), F.array_join(F.array_sort(F.collect_list(element)), ","), F.lit("]}")).alias("document"))
    doc = F.when(F.col("c_acctbal") < -900, F.substr("document", F.lit(1), F.length("document") - 2)).otherwise(F.col("document"))
    return c.join(by, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").cast("string").alias("path"), doc.alias("document"))


@query("""
WITH r AS (SELECT o_custkey::VARCHAR AS path, o_orderkey::VARCHAR AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'corrupt' WHEN o_orderstatus = 'P' THEN 'missing_field' WHEN o_orderpriority = '2-HIGH' THEN 'invalid_range' END AS reason
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= -900)
SELECT path, 'symbols' AS subject, coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT c_custkey::VARCHAR, 'output', CASE WHEN o_custkey IS NULL THEN 'missing' ELSE 'corrupt' END, 1 FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey WHERE o_custkey IS NULL OR c_acctbal < -900
""")
def indexer_outcomes(spark, d):
    """What became of every record and document of an indexer's outputs, counted by document."""
    x = op.index_output(_outputs(spark, d))
    good = x.tables["symbols"].select("path", F.lit("symbols").alias("subject"), F.lit("accepted").alias("outcome"))
    return good.union(x.quarantine.select("path", "subject", "reason")).groupBy("path", "subject", "outcome").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT doc_id, i, substring(text, i, 1) AS c FROM documents, unnest(range(1, 401)) AS t(i) WHERE i <= length(text)),
b AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM c)
SELECT doc_id, coalesce(string_agg(c, '' ORDER BY i) FILTER (upto - strlen(c) >= 100 AND upto <= 333), '') AS excerpt FROM documents LEFT JOIN b USING (doc_id) GROUP BY doc_id
""")
def byte_excerpts(spark, d):
    """Bytes 100 to 332 of every document as text, whole code points only."""
    return load(spark, d, "documents").select("doc_id", op.excerpt(F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.lit(100), F.lit(333), redact=False).alias("excerpt"))


@query("SELECT sha256(html) AS digest, octet_length(encode(html)) AS size, 'text/html' AS media_type, 1 AS calls_that_added, true AS intact FROM (SELECT DISTINCT html FROM pages WHERE html IS NOT NULL)")
def stored_artifacts(spark, d):
    """All pages' bytes as stored under their digests, after they were stored twice."""
    root = f"{shared_dir(spark)}/artifact-store-{uuid.uuid4().hex}"
    pages = load(spark, d, "pages").select(F.col("html").cast("binary").alias("content"), F.lit("text/html").alias("media_type"))
    added = sum(op.persist(pages, root) > 0 for _ in range(2))
    x = op.artifacts(spark, root)
    return x.select("digest", "size", "media_type", F.lit(added).alias("calls_that_added"), (F.sha2("content", 256) == F.col("digest")).alias("intact"))


def _first_above(s, c):
    """(s_nationkey, s_suppkey, k): the first customer of the nation above nine times the supplier's key; a window, as a join would pair each
    supplier with all customers above."""
    history = c.where("c_nationkey is not null").select(F.col("c_nationkey").alias("s_nationkey"), (-F.col("c_custkey")).alias("since"), F.col("c_custkey").alias("k"))
    points = s.select("s_nationkey", "s_suppkey", (-1 - 9 * F.col("s_suppkey")).alias("at")).distinct()  # the first customer above: from the other end, the last one up to it
    return as_of(points, history, "s_nationkey", "at", "since", ["k"], "k").withColumnRenamed("last_k", "k")


@query("""
WITH RECURSIVE c AS (SELECT c_nationkey AS n, 'c' || c_custkey AS k, coalesce('c' || lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 'end') AS nxt, c_mktsegment = 'BUILDING' AS leaf FROM customer),
f AS (SELECT s_nationkey AS n, s_suppkey AS s, coalesce('c' || min(c_custkey), 'end') AS k FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_custkey > 9 * s_suppkey GROUP BY ALL),
w(n, s, k) AS (SELECT n, s, k FROM f UNION SELECT w.n, w.s, c.nxt FROM w JOIN c ON c.n = w.n AND c.k = w.k WHERE NOT leaf)
SELECT n::VARCHAR AS application_id, 'GET' AS "method", '/suppliers/s' || s AS path, array_to_string(list_sort(list('#/components/schemas/' || k)), ',') AS refs, CASE WHEN bool_or(k = 'end') THEN '#/components/schemas/end' ELSE '' END AS missing FROM w GROUP BY n, s
""")
def schema_references(spark, d):
    """The schemas that each supplier's operation needs, in API documents by nation where a customer's schema refers to the next customer's (that of
    a builder to none, the last one to a schema that is not there)."""
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    ref = lambda k: F.concat(F.lit("#/components/schemas/"), F.coalesce(k, F.lit("end")))
    name = lambda k: F.concat(F.lit("c"), k)
    nxt = F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    one = c.withColumn("next", ref(name(nxt))).select("c_nationkey", F.struct(name("c_custkey").alias("k"), F.when(F.col("c_mktsegment") != "BUILDING", F.create_map(F.lit("$ref"), "next")).alias("v")).alias("e"))
    schemas = one.select("c_nationkey", F.struct(F.col("e.k").alias("k"), F.struct(F.col("e.v").alias("properties")).alias("v")).alias("e")).groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list("e")).alias("schemas"))
    first = _first_above(s, c)
    schema = F.create_map(F.lit("$ref"), ref(name("k")))
    answer = F.create_map(F.lit("200"), F.struct(F.create_map(F.lit("application/json"), F.struct(schema.alias("schema"))).alias("content")))
    path = F.struct(F.concat(F.lit("/suppliers/s"), "s_suppkey").alias("k"), F.struct(F.struct(answer.alias("responses")).alias("get")).alias("v"))
    paths = first.select("s_nationkey", path.alias("p")).groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list("p")).alias("paths"))
    docs = paths.join(schemas, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    docs = docs.select(F.col("s_nationkey").cast("string").alias("application_id"), F.to_json(F.struct("paths", F.struct("schemas").alias("components"))).alias("document"))
    x = api_references.references(docs).where("side = 'response'")
    return x.select("application_id", "method", "path", F.array_join("refs", ",").alias("refs"), F.array_join("missing", ",").alias("missing"))
