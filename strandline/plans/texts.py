"""Queries over text, addresses and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import texts as op
from strandline.plans.registry import load, query
from strandline.sources import html


@query("""
SELECT p_partkey, 'sha256:' || sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS content_hash,
  'part:v1:' || sha256('{"identity":{"brand":"' || p_brand || '","partkey":' || p_partkey || '},"kind":"part","version":1}') AS stable_key FROM part
""")
def content_hash_ids(spark, d):
    """Content hashes and typed keys from canonical JSON."""
    return load(spark, d, "part").select(
        "p_partkey", tx.content_hash(brand=F.col("p_brand"), name=F.col("p_name"), size=F.col("p_size")).alias("content_hash"), tx.stable_key("part", brand=F.col("p_brand"), partkey=F.col("p_partkey")).alias("stable_key")
    )


def _redaction_sql() -> str:
    c = "coalesce(text, '')"
    for pattern, to in tx.SECRETS:
        c = "regexp_replace({}, '{}', '{}', 'g')".format(c, pattern, to.replace("$1", r"\1"))
    return f"SELECT doc_id, sha256({c}) AS redacted_sha256, {c} <> coalesce(text, '') AS changed FROM documents"


@query(_redaction_sql())
def redaction(spark, d):
    """Documents without secrets (a digest of the whole redacted text)."""
    t = F.coalesce("text", F.lit(""))
    x = load(spark, d, "documents").select("doc_id", t.alias("t"), tx.redact(t).alias("r"))  # redacted once for both columns
    return x.select("doc_id", F.sha2(F.col("r").cast("binary"), 256).alias("redacted_sha256"), (F.col("r") != F.col("t")).alias("changed"))


@query(r"""
WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages),
p AS (SELECT page_id, lower(regexp_extract(b, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) AS head, regexp_replace(regexp_extract(b, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)', 1), '/{2,}', '/', 'g') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid)(=|$)'))), '&') AS q FROM u)
SELECT page_id, head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM p
""")
def url_canonical(spark, d):
    """Canonical page addresses."""
    return load(spark, d, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query(r"""
SELECT page_id, '/' || array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''),
  lambda s: CASE WHEN regexp_matches(s, '^\d+$') THEN '{id}' ELSE s END), '/') AS route FROM pages
""")
def endpoint_normalize(spark, d):
    """Paths of page addresses with numbers as {id}."""
    return load(spark, d, "pages").select("page_id", tx.route_template(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)).alias("route"))


_GRAMS = "list_distinct(list_transform(range(1, length(t) + 3), lambda i: substr('  ' || t || '  ', i, 3)))"


@query(f"""
WITH n AS (SELECT p_name AS name, count(*) AS rows, CASE WHEN length(p_name) > 3 AND p_name LIKE '%s' THEN left(p_name, -1) ELSE p_name END AS t FROM part GROUP BY p_name),
g AS (SELECT name, rows, {_GRAMS} AS g FROM n)
SELECT * FROM (SELECT a.name AS a, b.name AS b, round(2 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) AS dice, a.rows AS a_rows, b.rows AS b_rows FROM g a JOIN g b ON a.name < b.name) WHERE dice >= 0.5
""")
def dice_trigram(spark, d):
    """Pairs of part names with alike trigrams, with the number of parts of each name."""
    x = op.similar_names(load(spark, d, "part"), "p_name", 0.5)
    return x.withColumn("dice", F.round("dice", 6))


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(lang, '') || ' ' || coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w, lower(lang) AS h FROM documents),
c AS (SELECT doc_id, h, greatest(1, len(w)) AS n, t, len(list_filter(w, lambda x: x = t)) AS c FROM w, (VALUES ('en'), ('the'), ('that')) v(t)),
f AS (SELECT t, count(*) FILTER (c > 0) AS df, count(*) AS n_all FROM c GROUP BY t)
SELECT doc_id, round(sum(c / n * ln(1 + n_all / df) * CASE WHEN h = t THEN 3 ELSE 1 END), 6) AS score FROM c JOIN f USING (t) WHERE c > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20
""")
def tfidf_search(spark, d):
    """The 20 best documents for some terms (a top-k report over all documents); the language stands as heading."""
    x = op.tfidf(load(spark, d, "documents"), "doc_id", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")), ["en", "the", "that"])
    return x.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_props(spark, d):
    """A key of each event's JSON, and one that is never there."""
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("SELECT doc_id, first, doc_id = first AS kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first FROM documents)")
def page_dedup(spark, d):
    """Exact copies of documents: the first of each text stays."""
    x = load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    first = x.groupBy("h").agg(F.min("doc_id").alias("first"))
    return x.join(first, "h").select("doc_id", "first", (F.col("doc_id") == F.col("first")).alias("kept"))


@query(r"""
WITH f AS (SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) AS f FROM documents)
SELECT doc_id, canonical_id, members, doc_id = canonical_id AS kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS canonical_id, count(*) OVER (PARTITION BY f) AS members FROM f) WHERE members > 1
""")
def duplicate_groups(spark, d):
    """Documents whose normalised statement occurs more than once, with the canonical one."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
    return op.duplicate_members(load(spark, d, "documents"), "doc_id", F.sha2(norm.cast("binary"), 256))


@query("""
SELECT user_id, date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'purchase') AS one, count(*) FILTER (event_type = 'error') AS other FROM events GROUP BY ALL HAVING one > 0 AND other > 0
""")
def polarity_conflicts(spark, d):
    """Days on which a user both bought and failed."""
    e = load(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return op.both_sides(e, ["user_id", "day"], F.col("event_type") == "purchase", F.col("event_type") == "error")


_KEPT = "' ' || array_to_string(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in tx.SUPPORT_STOP_WORDS) + ")), ' ') || ' '"


@query(f"""
WITH d AS (SELECT doc_id, {_KEPT.format("text")} AS t FROM documents), b AS (SELECT item_id, {_KEPT.format("text")} AS p FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(t, p) WHERE length(p) > 2
""")
def token_subsequence(spark, d):
    """Documents that hold all words of a benchmark item in a row, stop words and single characters left out."""
    kept = F.array_join(tx.kept_words(F.col("text")), " ")
    docs, items = load(spark, d, "documents").select("doc_id", kept.alias("text")), load(spark, d, "benchmark").select("item_id", kept.alias("passage"))
    return op.passages_in(docs, items, "doc_id", "text", "item_id", "passage")


#: What the scan looks for, by rule.
SCAN = (
    ("private-key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9._-]{20,}\b"),
    ("github-fine-grained-pat", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("openai-key", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b"),
    ("aws-access-key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", "[0-9]{3}-[0-9]{3}-[0-9]{4}"),
)


@query("WITH l AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS s FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)) " + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS rule, line, sha256('{n}:' || h) AS fingerprint FROM l, unnest(regexp_extract_all(s, '{p}')) t(h)" for n, p in SCAN))
def secret_scan(spark, d):
    """Every match of the scan's rules in documents, by line."""
    return op.secret_hits(load(spark, d, "documents"), "doc_id", "text", list(SCAN))


@query("""
WITH c AS (SELECT p_partkey, p_name, p_size, p_size < 25 AS allowed, list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) > 1)) AS k FROM part WHERE p_brand <> 'Brand#3'),
t AS (SELECT *, list_transform(k, lambda x: x) AS toks FROM c)
SELECT p_partkey, p_name, least(1000, 80 * len(list_intersect(toks, ['bolt', 'gear', 'hot', 'red'])) + 120 * (CASE WHEN list_has_any(toks, ['bolt', 'red']) THEN 1 ELSE 0 END + CASE WHEN list_has_any(toks, ['gear', 'hot']) THEN 1 ELSE 0 END)
  + CASE WHEN allowed THEN 100 ELSE 0 END + 80)::BIGINT AS score FROM t
""")
def rank_candidates(spark, d):
    """Parts not yet visited, scored by words shared with hints."""
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    seen = p.where("p_brand = 'Brand#3'").select("p_partkey")
    return op.rank_by_hints(p, "p_name", ["red bolt", "hot gear"], F.col("p_size") < 25, seen, "p_partkey").select("p_partkey", "p_name", "score")


@query()
def html_sections(spark, d):
    """Sections of pages by heading, with offsets (tested against hand-written pages)."""
    return html.sections(load(spark, d, "pages"), "page_id", "html")


@query()
def markdown_sections(spark, d):
    """Sections of documents read as Markdown (tested against hand-written documents)."""
    return html.markdown_sections(load(spark, d, "documents"), "doc_id", "text")


@query("""
WITH p AS (SELECT page_id, url, 'http://' || split_part(split_part(url, '://', 2), '/', 1) AS root, ['get ', 'Post', 'trace', 'FETCH'][page_id % 4 + 1] AS m FROM pages)
SELECT page_id, url = root || '/docs' OR starts_with(url, root || '/docs/') OR starts_with(url, root || '/docs?') AS inside, CASE WHEN upper(trim(m)) IN ('GET', 'POST', 'TRACE') THEN upper(trim(m)) END AS method FROM p
""")
def scoped_requests(spark, d):
    """Requests for pages: whether the address lies in its site's documentation, and the method if it is one."""
    p = load(spark, d, "pages")
    root = F.concat(F.lit("http://"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)), F.lit("/docs"))
    method = F.get(F.array(*[F.lit(m) for m in ("get ", "Post", "trace", "FETCH")]), (F.col("page_id") % 4).cast("int"))
    return p.select("page_id", tx.in_scope(F.col("url"), root).alias("inside"), tx.http_method(method).alias("method"))
