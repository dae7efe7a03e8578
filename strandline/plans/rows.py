"""Queries over single rows and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import rows as op
from strandline.plans.registry import load, query

_ENTITIES = """
  SELECT 'customer' AS kind, 'c' || c_custkey AS id, coalesce(c_name, 'customer ' || c_custkey) AS title FROM customer
  UNION ALL SELECT 'supplier', 's' || s_suppkey, coalesce(s_name, 'supplier ' || s_suppkey) FROM supplier
  UNION ALL SELECT 'part', 'p' || p_partkey, coalesce(p_name, p_brand, 'part ' || p_partkey) FROM part
"""


def entities(spark, d):
    pick = lambda t, kind, key, *names: load(spark, d, t).select(
        F.lit(kind).alias("kind"), F.concat(F.lit(kind[0]), F.col(key)).alias("id"), F.coalesce(*names, F.concat(F.lit(f"{kind} "), F.col(key))).alias("title")
    )
    return pick("customer", "customer", "c_custkey", "c_name").union(pick("supplier", "supplier", "s_suppkey", "s_name")).union(pick("part", "part", "p_partkey", "p_name", "p_brand"))


@query(_ENTITIES)
def entity_projection(spark, d):
    """Rows of several kinds as (kind, id, title), the title by the first name there is."""
    return entities(spark, d)


@query(f"SELECT * FROM ({_ENTITIES}) WHERE kind IN ('part', 'supplier') ORDER BY title, id LIMIT 200")
def kind_list_limit(spark, d):
    """The first 200 entities of some kinds by title (a top-k report)."""
    return entities(spark, d).where(F.col("kind").isin("part", "supplier")).orderBy("title", "id").limit(200)


@query("""
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY d, o_orderkey) > 50 AS is_next FROM (
  SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders
  WHERE (strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) > ('1995-06-01', 0) ORDER BY d, o_orderkey LIMIT 51)
""")
def keyset_page(spark, d):
    """A page of 50 orders after a cursor of date and key."""
    o = load(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderkey", "o_totalprice")
    return op.keyset_page(o, ["d", "o_orderkey"], ("1995-06-01", 0), 50).drop("d")


@query("""
SELECT page_id, CASE WHEN url IS NULL THEN 'missing' WHEN url NOT LIKE '%://%' THEN 'malformed' WHEN url LIKE 'http://%' THEN 'insecure'
  WHEN regexp_matches(url, '[?]') THEN 'query' WHEN regexp_matches(url, '#') THEN 'fragment' ELSE 'admitted' END AS decision FROM pages
""")
def case_ladder_admission(spark, d):
    """Each page's first reason for exclusion, or admitted."""
    u = F.col("url")
    rules = [(u.isNull(), "missing"), (~u.contains("://"), "malformed"), (u.startswith("http://"), "insecure"), (u.contains("?"), "query"), (u.contains("#"), "fragment")]
    return load(spark, d, "pages").select("page_id", op.first_match(rules, "admitted").alias("decision"))


@query("""
SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_filter([
  CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_discount >= 0.05 THEN 'discounted' END,
  CASE WHEN l_quantity > 30 THEN 'bulk' END, CASE WHEN l_linestatus = 'O' THEN 'open' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM lineitem
""")
def multi_label_reasons(spark, d):
    """All reasons that hold for a line, in order."""
    rules = [(F.col("l_returnflag") == "R", "returned"), (F.col("l_discount") >= 0.05, "discounted"), (F.col("l_quantity") > 30, "bulk"), (F.col("l_linestatus") == "O", "open")]
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", op.labels(rules).alias("reasons"))


@query("""
SELECT l_orderkey, bool_and(l_quantity >= 5) AS all_large, bool_or(l_returnflag = 'R') AS any_returned, NOT bool_or(l_discount > 0.09) AS none_steep
FROM lineitem GROUP BY l_orderkey
""")
def forall_exists_predicate(spark, d):
    """Orders by quantified conditions over their lines: all, any, none."""
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_quantity") >= 5).alias("all_large"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), (~F.bool_or(F.col("l_discount") > 0.09)).alias("none_steep")
    )


@query("""
SELECT 'duplicate_line' AS code, l_orderkey || '-' || l_linenumber AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'duplicate_order', o_orderkey::VARCHAR FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'orphan_line', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orphan_order', o_custkey::VARCHAR FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'negative_price', o_orderkey::VARCHAR FROM orders WHERE o_totalprice < 0
""")
def integrity_violations(spark, d):
    """Rows that would forbid publication, by code."""
    lines, orders, customers = (load(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return op.violations([
        ("duplicate_line", op.duplicates(lines, ["l_orderkey", "l_linenumber"]).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))),
        ("duplicate_order", op.duplicates(orders, ["o_orderkey"])),
        ("orphan_line", op.orphans(lines, "l_orderkey", orders, "o_orderkey")),
        ("orphan_order", op.orphans(orders, "o_custkey", customers, "c_custkey")),
        ("negative_price", orders.where("o_totalprice < 0").select("o_orderkey")),
    ])


@query("""
SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON o.o_custkey = c_custkey AND o.rn = 1
""")
def left_lateral_latest(spark, d):
    """Each customer with the latest order, customers without one kept."""
    last = op.latest(load(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    c = load(spark, d, "customer").select("c_custkey")
    return c.join(last, c["c_custkey"] == last["o_custkey"], "left").drop("o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_join_owned(spark, d):
    """Customers with an open order."""
    open_ = load(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(open_, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join_missing(spark, d):
    """Customers without a pending order."""
    some = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(some, "c_custkey", "left_anti")


_WINDOWS = """orders_w AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS s,
  date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 10 + (o_orderkey % 7) * 10 AS e FROM orders)"""


def _order_windows(spark, d):
    o = load(spark, d, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return o.select("o_custkey", "o_orderkey", day.alias("s"), (day + 10 + (F.col("o_orderkey") % 7) * 10).alias("e"))


@query(f"""
WITH {_WINDOWS}, points AS (SELECT o_custkey, l_orderkey, l_linenumber, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
hit AS (SELECT p.l_orderkey, p.l_linenumber, w.e - w.s AS size, w.o_orderkey AS name FROM points p JOIN orders_w w ON w.o_custkey = p.o_custkey AND p.at BETWEEN w.s AND w.e),
best AS (SELECT l_orderkey, l_linenumber, count(DISTINCT name) AS n, min(name) AS name FROM
  (SELECT *, min(size) OVER (PARTITION BY l_orderkey, l_linenumber) AS m FROM hit) WHERE size = m GROUP BY ALL)
SELECT DISTINCT p.l_orderkey, p.l_linenumber, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome,
  CASE WHEN n = 1 THEN name END AS name FROM points p LEFT JOIN best b ON b.l_orderkey = p.l_orderkey AND b.l_linenumber = p.l_linenumber
""")
def innermost_interval(spark, d):
    """Each shipped line with the smallest order window of its customer that holds the ship date; ties are ambiguous."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    p = load(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber", day.alias("at"))
    return op.innermost(p, _order_windows(spark, d), ["o_custkey"], "at", "s", "e", "o_orderkey", ["l_orderkey", "l_linenumber"], 32)


@query(f"WITH {_WINDOWS} SELECT a.o_custkey, a.o_orderkey AS a_id, b.o_orderkey AS b_id FROM orders_w a JOIN orders_w b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s <= b.e AND b.s <= a.e")
def range_overlap_join(spark, d):
    """Pairs of a customer's order windows that overlap."""
    return op.overlaps(_order_windows(spark, d), "o_custkey", "s", "e", "o_orderkey", 32)


_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1)"


@query(f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || {_PATH} AS path FROM pages),
parts AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM p),
pre AS (SELECT page_id, array_to_string(s[1:i], '/') AS prefix, i = len(s) AS whole FROM parts, unnest(range(1, len(s) + 1)) t(i))
SELECT DISTINCT a.prefix AS ancestor, b.page_id FROM (SELECT DISTINCT array_to_string(s[1:2], '/') AS prefix FROM parts WHERE len(s) > 2) a JOIN pre b USING (prefix) WHERE NOT b.whole
""")
def path_prefix_join(spark, d):
    """The first directories of sites with all pages below them: an equi-join on exploded prefixes."""
    u = F.col("url")
    path = F.concat(F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1), F.lit("/"), F.regexp_extract(u, "^[a-z]+://[^/?#]+/?([^?#]*)", 1))
    p = load(spark, d, "pages").select("page_id", F.reverse(op.ancestors(path)).alias("every"))
    below = p.select("page_id", F.posexplode("every").alias("up", "prefix")).where("up > 0")
    directories = p.where(F.size("every") > 2).select(F.element_at("every", -2).alias("prefix")).distinct()
    return directories.join(below, "prefix").select(F.col("prefix").alias("ancestor"), "page_id").distinct()


#: The route templates of the template-match query.
TEMPLATES = (("/en/{id}", "GET"), ("/fr/{id}", "GET"), ("/{lang}/{id}", "GET"), ("/de/{id}", "POST"), ("/{lang}/7", "GET"), ("/es/{a}", "GET"), ("/es/{b}", "GET"), ("/about", "GET"))
_TEMPLATES = ", ".join(f"('{t}', '{m}')" for t, m in TEMPLATES)


@query(f"""
WITH t AS (SELECT template, method, list_filter(string_split(template, '/'), lambda x: x <> '') AS ts FROM (VALUES {_TEMPLATES}) v(template, method)),
r AS (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS rs FROM pages),
hit AS (SELECT page_id, template, method, len(list_filter(ts, lambda x: x[1] <> '{{')) AS fixed FROM r JOIN t ON len(rs) = len(ts)
  AND len(list_filter(range(1, len(ts) + 1), lambda i: ts[i][1] = '{{' OR ts[i] = rs[i])) = len(ts)),
best AS (SELECT page_id, count(DISTINCT template) AS n, min(template) AS template, max(CASE WHEN method = 'GET' THEN 1 ELSE 0 END) AS fits
  FROM (SELECT *, max(fixed) OVER (PARTITION BY page_id) AS m FROM hit) WHERE fixed = m GROUP BY page_id)
SELECT r.page_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'candidate' WHEN fits = 0 THEN 'conflict' ELSE 'exact' END AS outcome,
  CASE WHEN n = 1 THEN template END AS template FROM r LEFT JOIN best b ON b.page_id = r.page_id
""")
def template_match(spark, d):
    """Page addresses against route templates, by specificity; ambiguity and method conflicts stay visible."""
    r = load(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+/?([^?#]*)", 1).alias("path"), F.lit("GET").alias("verb"))
    t = spark.createDataFrame(list(TEMPLATES), "template string, method string")
    return op.match_templates(r, t, "path", "verb", "page_id")


_SIDE = "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, {key} AS k, l_partkey || ':' || l_suppkey || ':' || CAST(l_quantity AS INTEGER) AS c FROM lineitem WHERE l_linestatus = '{s}'"


@query(f"""
WITH b AS ({_SIDE.format(key="l_partkey || '-' || l_suppkey", s="F")}), h AS ({_SIDE.format(key="l_partkey || '-' || l_suppkey", s="O")}),
b1 AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM b), h1 AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM h),
same AS (SELECT b1.id AS base_id, h1.id AS head_id, CASE WHEN b1.c = h1.c THEN 'unchanged' ELSE 'modified' END AS change FROM b1 JOIN h1 ON b1.k = h1.k AND b1.n = 1 AND h1.n = 1),
b2 AS (SELECT *, count(*) OVER (PARTITION BY c) AS m FROM b WHERE id NOT IN (SELECT base_id FROM same)),
h2 AS (SELECT *, count(*) OVER (PARTITION BY c) AS m FROM h WHERE id NOT IN (SELECT head_id FROM same)),
moved AS (SELECT b2.id AS base_id, h2.id AS head_id, 'moved' AS change FROM b2 JOIN h2 ON b2.c = h2.c AND b2.m = 1 AND h2.m = 1)
SELECT * FROM same UNION ALL SELECT * FROM moved
UNION ALL SELECT id, NULL, 'deleted' FROM b2 WHERE id NOT IN (SELECT base_id FROM moved) UNION ALL SELECT NULL, id, 'added' FROM h2 WHERE id NOT IN (SELECT head_id FROM moved)
""")
def full_outer_structural(spark, d):
    """Closed lines against open lines as base and head: unchanged, modified, moved, deleted, added."""
    x = load(spark, d, "lineitem").select("l_linestatus", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("k"), F.concat_ws(":", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("c"))
    return op.structural_diff(x.where("l_linestatus = 'F'"), x.where("l_linestatus = 'O'"), "k", "c", "id")


@query("""
SELECT e.event_id, (SELECT max_by(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND p.ts <= e.ts) AS last_event_id
FROM events e WHERE e.event_type = 'purchase'
""")
def latest_revision_asof(spark, d):
    """Each purchase with the user's newest signup not after it."""
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    p, s = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), e.where("event_type = 'signup'")
    return op.as_of(p, s, "user_id", "ts", "ts", ["event_id"], "event_id").select("event_id", "last_event_id")


@query("""
SELECT a.l_orderkey, a.l_suppkey, a.l_linenumber AS line, list_sort(list(DISTINCT b.l_linenumber))::VARCHAR AS competing FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber <> b.l_linenumber GROUP BY ALL
""")
def parallel_edges(spark, d):
    """Lines of an order that share their supplier, each with its competitors."""
    x = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    by = x.groupBy("l_orderkey", "l_suppkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("all")).where(F.size("all") > 1)
    each = by.select("l_orderkey", "l_suppkey", "all", F.explode("all").alias("line"))
    others = F.array_except("all", F.array("line"))
    return each.where(F.size(others) > 0).select("l_orderkey", "l_suppkey", "line", F.concat(F.lit("["), F.array_join(others.cast("array<string>"), ", "), F.lit("]")).alias("competing"))


@query("""
WITH desired AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT 1000000 + p_partkey, p_brand, 0 FROM part WHERE p_size = 1)
SELECT coalesce(e.s_suppkey, d.s_suppkey) AS s_suppkey, CASE WHEN e.s_suppkey IS NULL THEN 'insert' WHEN d.s_suppkey IS NULL THEN 'delete'
  WHEN (e.s_name, e.s_nationkey) IS NOT DISTINCT FROM (d.s_name, d.s_nationkey) THEN 'keep' ELSE 'update' END AS action
FROM supplier e FULL JOIN desired d ON e.s_suppkey = d.s_suppkey
""")
def declarative_sync(spark, d):
    """What makes the suppliers equal to a desired set."""
    s = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    want = s.where("s_acctbal > 0").drop("s_acctbal").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 5 == 0, -1).otherwise(F.col("s_nationkey")))
    new = load(spark, d, "part").where("p_size = 1").select((F.col("p_partkey") + 1000000).alias("s_suppkey"), F.col("p_brand").alias("s_name"), F.lit(0).alias("s_nationkey"))
    return op.sync_labels(s.drop("s_acctbal"), want.union(new), "s_suppkey", ["s_name", "s_nationkey"])


@query("""
WITH affected AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0), staged AS (SELECT s_suppkey, upper(s_name) AS s_name FROM supplier WHERE s_acctbal > 5000)
SELECT s_suppkey, s_name, 'copied' AS origin, 2::BIGINT AS graph_revision FROM supplier
  WHERE s_suppkey NOT IN (SELECT s_suppkey FROM affected) AND s_suppkey NOT IN (SELECT s_suppkey FROM staged)
UNION ALL SELECT s_suppkey, s_name, 'staged', 2 FROM staged
""")
def copy_on_write_revision(spark, d):
    """The next revision of a table: unaffected rows copied, staged rows added."""
    s = load(spark, d, "supplier")
    staged = s.where("s_acctbal > 5000").select("s_suppkey", F.upper("s_name").alias("s_name"))
    return op.copy_on_write(s.select("s_suppkey", "s_name"), s.where("s_acctbal < 0"), staged, "s_suppkey", 2)


@query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 100000 AND NOT EXISTS (SELECT 1 FROM (VALUES ('1-URGENT', DATE '1997-01-01'), ('5-LOW', DATE '1994-01-01')) x(p, until)
  WHERE x.p = o_orderpriority AND x.until >= o_orderdate::DATE)
""")
def exception_anti_join(spark, d):
    """Large orders without an exception for their priority that was still in force on their date."""
    x = spark.createDataFrame([("1-URGENT", "1997-01-01"), ("5-LOW", "1994-01-01")], "p string, until string")
    o = load(spark, d, "orders").where("o_totalprice > 100000")
    return o.join(x, (F.col("p") == F.col("o_orderpriority")) & (F.col("until").cast("date") >= F.col("o_orderdate").cast("date")), "left_anti").select("o_orderkey", "o_orderpriority")


@query("""
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200)) WHERE place <= 3
""")
def offset_page_per_group_cap(spark, d):
    """A page of orders by offset, with at most three lines of each (a paging tool: offset and caps are the feature)."""
    from pyspark.sql import Window

    page = load(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(200).limit(100)
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    x = load(spark, d, "lineitem").join(page, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return x.withColumn("place", F.row_number().over(w)).where("place <= 3").select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("place").cast("bigint").alias("place"))
