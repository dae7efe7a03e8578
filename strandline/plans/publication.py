"""Publications of the graph of orders and customers, and document maps, as they read afterwards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions.tables import shared_dir
from strandline.operators import publish as op
from strandline.plans.graphs import _id
from strandline.plans.registry import load, query


def _published(spark, d) -> str:
    """Revision 1: all customers and orders. Revision 2: orders of status P are affected; of these only those of 200,000 and more come
    back, titled anew. A third revision is staged, never activated, and rolled back."""
    root = f"{shared_dir(spark)}/publication-{uuid.uuid4().hex}"
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    node = lambda df, ident, kind, title: df.select(ident.alias("id"), F.lit(kind).alias("kind"), title.alias("title"))
    edge = lambda df: df.select(F.concat_ws(">", _id("o", "o_orderkey"), _id("c", "o_custkey")).alias("id"), _id("o", "o_orderkey").alias("from_id"), _id("c", "o_custkey").alias("to_id"), F.lit("A").alias("tier"), F.lit("accepted").alias("review_state"))
    op.publish(spark, root, node(c, _id("c", "c_custkey"), "customer", F.col("c_name")).union(node(o, _id("o", "o_orderkey"), "order", F.col("o_orderpriority"))), edge(o))
    again = o.where("o_orderstatus = 'P' and o_totalprice >= 200000")
    affected = o.where("o_orderstatus = 'P'").select(_id("o", "o_orderkey").alias("id"))
    op.publish(spark, root, node(again, _id("o", "o_orderkey"), "order", F.lit("partly sent")), edge(again), affected)
    op.stage(spark, root, node(c, _id("c", "c_custkey"), "customer", F.lit("never seen")), edge(o).limit(0))
    op.rollback(spark, root)
    return root


@query("""
SELECT 'c' || c_custkey AS id, 'customer' AS kind, c_name AS title, 2 AS revision FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'order', CASE WHEN o_orderstatus = 'P' THEN 'partly sent' ELSE o_orderpriority END, 2 FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice >= 200000
""")
def published_nodes(spark, d):
    """The nodes that readers see after two publications and one that was rolled back."""
    root = _published(spark, d)
    return op.read(spark, root, "nodes").withColumn("revision", F.lit(op.current(spark, root)))


@query("SELECT 'o' || o_orderkey || '>c' || o_custkey AS id, 'o' || o_orderkey AS from_id, 'c' || o_custkey AS to_id FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice >= 200000")
def published_edges(spark, d):
    """The edges that readers see: those that came anew, and those carried over between nodes that stay."""
    return op.read(spark, _published(spark, d), "edges").select("id", "from_id", "to_id")


@query("""
SELECT 'en' AS scope, doc_id AS page_id, length(text) AS size, 1 AS version FROM documents WHERE lang = 'en'
UNION ALL SELECT 'rest', doc_id, length(text), 2 FROM documents WHERE lang IS DISTINCT FROM 'en' AND length(text) > 200
""")
def replaced_maps(spark, d):
    """Two document maps: one written again with the same content (version 1), one replaced by fewer pages (version 2)."""
    root = f"{shared_dir(spark)}/maps-{uuid.uuid4().hex}"
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "lang", F.length("text").alias("size"))
    english, rest = docs.where("lang = 'en'").drop("lang"), docs.where("not lang <=> 'en'").drop("lang")
    for scope, pages in (("en", english), ("rest", rest), ("en", english), ("rest", rest.where("size > 200"))):
        op.replace_map(spark, root, scope, {"pages": pages, "links": pages.select("page_id").limit(0)})
    return op.read_map(spark, root, "pages").join(op.maps(spark, root).select("scope", "version"), "scope")
