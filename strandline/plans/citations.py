"""Citations of claims, and request paths put together from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import citations as ct, text as tx
from strandline.plans.registry import load, query


@query()
def citation_places(spark, d):
    """Where the fifth to twelfth word of every document stand in its text for the first time, and what is cut there (tested against a search)."""
    word, gap = f"{ct._WORD}+", f"{ct.BLANK}++"  # possessive: neither gives anything back
    eight = F.regexp_extract("text", f"^(?:{gap})?(?:{word}{gap}){{4}}({word}(?:{gap}{word}){{0,7}})", 1)  # reads twelve words, not the whole text
    x = load(spark, d, "documents").select("doc_id", "text", ct.normal(eight).alias("quote"))
    x = x.select("doc_id", "text", "quote", F.inline(F.array_compact(F.array(ct.locate(F.col("text"), F.col("quote"))))))  # a place is worked out once
    return x.select("doc_id", "quote", "start", "end", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("cut"))


def _sql_supports(quote: str, value: str) -> str:
    kept = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: len(w) > 1 AND NOT list_contains({list(tx.SUPPORT_STOP_WORDS)}, w))"
    return f"(len({kept(value)}) > 0 AND contains(' ' || array_to_string({kept(quote)}, ' ') || ' ', ' ' || array_to_string({kept(value)}, ' ') || ' '))"


_is = lambda x, p: f"""regexp_matches({x}, '(?i){p.replace("'", "''")}')"""
_FLAGS = {
    "too_long": "length(s) > 4096",
    "several_sentences": "len(regexp_extract_all(s, '[.!?]+')) > 1",
    "several_norms": f"len(regexp_extract_all(s, '(?i){ct.NORMATIVE}')) > 1",
    "compound_action": _is("s", ct.COMPOUND),
    "several_actions": _is("s", ct.MULTIPLE),
    "promotion": f"{_is('s', ct.EXCLUDED)} OR {_is('quote', ct.EXCLUDED)}",
    "vague": _is("s", ct.VAGUE),
    "setup_instruction": _is("s", ct.SETUP),
    "support_contact": _is("s", ct.SUPPORT),
    "excluded_heading": _is("heading", ct.HEADING),
    "no_norm": f"NOT ({_is('s', ct.NORMATIVE)} OR kind = 'acceptance_criterion' AND {_is('s', ct.CRITERION)} OR kind = 'requirement' AND length(s) <= 240 AND NOT contains(s, ';') AND {_sql_supports('quote', 's')})",
    "other_polarity": f"{_is('s', ct.NEGATIVE)} <> {_is('quote', ct.NEGATIVE)}",
    "statement_unsupported": f"NOT {_sql_supports('quote', 's')}",
    "capability_unsupported": f"NOT {_sql_supports('quote', 'capability')} OR NOT {_sql_supports('s', 'capability')}",
    "actor_unsupported": f"NOT {_sql_supports('quote', 'actor')}",
    "outcome_unsupported": f"outcome IS NOT NULL AND NOT {_sql_supports('quote', 'outcome')}",
    "outcome_missing": "kind = 'acceptance_criterion' AND outcome IS NULL",
}
#: Claims that a task judges.
CLAIMS_OF_A_TASK = 1 << 16
#: How statements of the query are put together, by status, priority and price.
_VERBS = {"F": "must pay", "O": "can add and view", "P": "never sees"}
_TAILS = {"1-URGENT": " in a fast way", "2-HIGH": ". Then stop!", "3-MEDIUM": "", "4-NOT SPECIFIED": " or may wait; email our team", "5-LOW": " when paid"}


@query(f"""
WITH c AS (SELECT o_orderkey, 'The ' || lower(c_mktsegment) || ' buyer ' || CASE o_orderstatus {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _VERBS.items())} END || ' the order'
    || CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TAILS.items())} END AS s, lower(c_mktsegment) || ' buyer' AS actor, o_totalprice AS v, o_orderpriority AS pr FROM orders JOIN customer ON c_custkey = o_custkey),
q AS (SELECT *, CASE WHEN v > 300000 THEN 'An order of the shop is not sent' WHEN v > 200000 THEN 'World''s best: ' || s ELSE s || ' at once' END AS quote, CASE WHEN v < 80000 THEN 'acceptance_criterion' ELSE 'requirement' END AS kind,
  CASE WHEN v > 150000 THEN 'Orders' ELSE 'Setup of orders' END AS heading, CASE WHEN v < 250000 THEN 'order' ELSE 'refund' END AS capability, CASE WHEN v > 40000 THEN 'the order' END AS outcome FROM c)
SELECT o_orderkey, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _FLAGS.items())}], lambda x: x IS NOT NULL), ',') AS objections FROM q
""")
def claim_objections(spark, d):
    """What speaks against statements about orders as testable claims that their quotes support."""
    o = load(spark, d, "orders")
    tasks = o.count() // CLAIMS_OF_A_TASK + 1  # dealt before they are judged: a file's parts are few, and judging takes long
    o = o.join(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "c_mktsegment").repartition(tasks, "o_orderkey")
    pick = lambda c, table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)]
    v, actor = F.col("o_totalprice"), F.concat(F.lower("c_mktsegment"), F.lit(" buyer"))
    s = F.concat(F.lit("The "), actor, F.lit(" "), pick("o_orderstatus", _VERBS), F.lit(" the order"), pick("o_orderpriority", _TAILS))
    quote = F.when(v > 300000, "An order of the shop is not sent").when(v > 200000, F.concat(F.lit("World's best: "), s)).otherwise(F.concat(s, F.lit(" at once")))
    kind, heading = F.when(v < 80000, "acceptance_criterion").otherwise("requirement"), F.when(v > 150000, "Orders").otherwise("Setup of orders")
    capability = F.when(v < 250000, "order").otherwise("refund")
    x = o.select("o_orderkey", *[c.alias(n) for n, c in (("kind", kind), ("s", s), ("quote", quote), ("heading", heading), ("capability", capability), ("actor", actor), ("outcome", F.when(v > 40000, "the order")))])
    found = ct.objections(*[F.col(c) for c in ("kind", "s", "quote", "heading", "capability", "actor", "outcome")])
    return x.select("o_orderkey", F.array_join(found, ",").alias("objections"))


@query("""
WITH e AS (SELECT event_id, [{'k': 'literal', 't': CASE WHEN user_id % 7 = 0 THEN '' ELSE '/api/' END}, {'k': CASE WHEN event_type = 'error' THEN 'parameter' ELSE 'literal' END, 't': event_type}, {'k': 'literal', 't': CASE WHEN value > 80 THEN '?' WHEN value > 40 THEN '/' ELSE '' END},
    {'k': 'parameter', 't': CASE WHEN user_id % 3 = 0 THEN 'q ? 1 : 2' ELSE 'id' END}, {'k': 'literal', 't': CASE WHEN value < 20 THEN '/stats?all' ELSE '//stats' END}, {'k': 'parameter', 't': props}] AS p FROM events),
n AS (SELECT *, list_min(list_filter(range(1, 7), lambda i: contains(p[i].t, '?') AND (p[i].k = 'literal' OR i > 1 AND NOT (p[i - 1].k = 'literal' AND ends_with(p[i - 1].t, '/'))))) AS stop, len(list_filter(p, lambda x: x.k = 'literal' AND x.t <> '')) > 0 AS known FROM e),
j AS (SELECT *, array_to_string(list_transform(p[1 : coalesce(stop - 1, 6)], lambda x: CASE WHEN x.k = 'literal' THEN x.t ELSE '{param}' END), '') || CASE WHEN p[stop].k = 'literal' THEN split_part(p[stop].t, '?', 1) ELSE '' END AS raw FROM n)
SELECT event_id, CASE WHEN known AND regexp_matches(raw, '[^/]') THEN '/' || array_to_string(list_filter(string_split(raw, '/'), lambda x: x <> ''), '/') END AS template, known AND stop IS NOT NULL AS has_query, true AS computed FROM j
""")
def request_templates(spark, d):
    """The path templates of calls whose paths are put together from literal text and expressions, their query cut off."""
    part = lambda kind, t: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(t) if isinstance(t, str) else t).alias("text"))
    u, v = F.col("user_id"), F.col("value")
    parts = F.array(
        part("literal", F.when(u % 7 == 0, "").otherwise("/api/")), part(F.when(F.col("event_type") == "error", "parameter").otherwise("literal"), F.col("event_type")),
        part("literal", F.when(v > 80, "?").when(v > 40, "/").otherwise("")), part("parameter", F.when(u % 3 == 0, "q ? 1 : 2").otherwise("id")),
        part("literal", F.when(v < 20, "/stats?all").otherwise("//stats")), part("parameter", F.col("props")),
    )
    return load(spark, d, "events").select("event_id", ct.request_path(parts).alias("p")).select("event_id", "p.*")
