"""From claims and evidence to links: every claim is validated, and ends in exactly one outcome.

claims: (claim_id, application_id, from_id, relationship, to_id, assertion, explanation, submitted, evidence_ids); evidence: (evidence_id, application_id, status,
method, source_kind, run_id, commit_sha, artifact_id, captured_at, bindings: array of (from_id, relationship, to_id)); policy: (relationship, clause,
method, tier), where each clause of a relationship needs one of its methods.

Rows of one claim_id, and of one evidence_id, are the same claim and evidence (the first in order of all columns counts). Claims and outcomes are
counted while they are written, and a difference is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions.tables import cut
from strandline.operators import links


@dataclass
class Linked:
    """outcomes: (claim_id, outcome, code, link_id), a row by claim: linked, conflict, rejected (with the first code that holds) or open (a
    contradiction of nothing that is supported). links and conflicts: a row by (from_id, relationship, to_id). evidence: (evidence_id, code) of
    evidence that does not count. counts: claims by outcome, as observed."""

    outcomes: DataFrame
    links: DataFrame
    conflicts: DataFrame
    evidence: DataFrame
    counts: dict[str, int]


def _first(df: DataFrame, key: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    # dealt by key before it is grouped: structs are grouped by sorting, and so the rows are sorted once, not on both sides of the shuffle
    return df.repartition(key).groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")


def link_id(application: str) -> Column:
    return tx.stable_key("evidence-link", application=F.lit(application), source=F.col("from_id").cast("string"), relationship=F.col("relationship"), target=F.col("to_id").cast("string"))


def validated(claims: DataFrame, evidence: DataFrame, policy: DataFrame, application: str) -> DataFrame:
    """claims with code, the first reason against each (null: none), tier, and what their evidence has in sum (ids, methods, runs, commits, artifacts,
    captured_at); evidence has the columns above and code.

    Reasons come in this order: another application; the first evidence in the claim's order that is missing or does not count; no policy for
    the relationship, or a method that it does not allow; a clause without a method; evidence that is not bound to the ends (of submitted claims).
    """
    ends = [F.col(c) for c in ("from_id", "relationship", "to_id")]  # a null end is bound to nothing
    own = ends[0].isNotNull() & ends[1].isNotNull() & ends[2].isNotNull() & F.array_contains("bindings", F.struct(*ends))
    known = evidence.drop("application_id", "status", "source_kind").withColumn("_there", F.lit(True))
    bad = F.when(F.col("_there").isNull(), "missing_evidence").otherwise(F.col("code"))
    bound = F.coalesce(own, F.lit(False))
    kinds = dict(evidence.dtypes)
    sets = {"_ids": "evidence_id", **{f"{c}s": c for c in ("method", "run_id", "commit_sha", "artifact_id")}}
    # a claim that cites one evidence has its facts from the join, and is neither grouped nor joined again
    alone = F.coalesce(F.size("evidence_ids") == 1, F.lit(False))
    one = claims.where(alone).withColumn("evidence_id", F.get("evidence_ids", F.lit(0))).join(known, "evidence_id", "left")
    one = one.select(*claims.columns, bad.alias("_bad"), bound.alias("_bound"), *[F.when(F.col(c).isNull(), F.array().cast(f"array<{kinds[c]}>")).otherwise(F.array(c)).alias(n) for n, c in sets.items()], "captured_at")
    several = claims.where(~alone)
    each = several.select("claim_id", "from_id", "relationship", "to_id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(known, "evidence_id", "left")
    all_of = each.groupBy("claim_id").agg(F.collect_list(F.struct("pos", bad.alias("bad"), bound.alias("bound"), *sets.values(), "captured_at")).alias("_all"))
    of = lambda c: F.transform("_all", lambda x: x[c])
    facts = all_of.select(
        "claim_id", F.array_min(F.filter(F.transform("_all", lambda x: F.struct(x["pos"], x["bad"].alias("bad"))), lambda x: x["bad"].isNotNull()))["bad"].alias("_bad"), F.forall("_all", lambda x: x["bound"]).alias("_bound"),
        *[F.array_sort(F.array_distinct(F.array_compact(of(c)))).alias(n) for n, c in sets.items()], F.array_max(of("captured_at")).alias("captured_at"),
    )
    clauses = policy.groupBy("relationship", "clause").agg(F.collect_set("method").alias("_any"), F.min("tier").alias("tier"))
    rules = clauses.groupBy("relationship").agg(F.collect_list("_any").alias("_clauses"), F.flatten(F.collect_list("_any")).alias("_allowed"), F.min("tier").alias("tier"))
    d = one.unionByName(several.join(facts, "claim_id", "left")).join(rules, "relationship", "left")
    methods = F.coalesce("methods", F.array().cast("array<string>"))
    code = (
        F.when(~F.col("application_id").eqNullSafe(F.lit(application)), "application_mismatch").when(F.col("_bad").isNotNull(), F.col("_bad"))
        .when(F.col("_clauses").isNull() | (F.size(F.array_except(methods, "_allowed")) > 0), "unsupported_relationship_evidence")
        .when(F.exists("_clauses", lambda c: ~F.arrays_overlap(c, methods)), "required_evidence_missing")
        .when(F.col("submitted") & ~F.coalesce("_bound", F.lit(True)), "evidence_binding_mismatch")
    )
    return d.withColumn("code", code).drop("_bad", "_bound", "_clauses", "_allowed", "evidence_ids").withColumnRenamed("_ids", "evidence_ids")


def link(
    claims: DataFrame, evidence: DataFrame, policy: DataFrame, application: str, methods: DataFrame, runs: DataFrame, commits: DataFrame, statuses: tuple[str, ...] = ("captured", "validated"), revision: int = 1
) -> Linked:
    """Links and conflicts of all claims that hold; methods(method, source_kind), runs(run_id) and commits(commit_sha) say what is compatible."""
    seen, left = Observation(), Observation()
    ev = cut(links.compatibility(_first(evidence, "evidence_id"), application, list(statuses), methods, runs, commits), "evidence")
    asked = cut(_first(claims, "claim_id").observe(seen, F.count(F.lit(1)).alias("n")), "claims")
    v = cut(validated(asked, ev, policy, application), "validated")
    ends = ["from_id", "relationship", "to_id"]
    side = lambda s: F.col("assertion") == s
    ids = lambda s: F.array_sort(F.collect_set(F.when(side(s), F.col("claim_id"))))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    good = v.where("code is null")
    sides = cut(good.groupBy(*ends).agg(F.bool_or(side("supports")).alias("_s"), F.bool_or(side("contradicts")).alias("_c")), "sides")

    outcome = F.when(F.col("code").isNotNull(), "rejected").when(F.col("_s") & F.col("_c"), "conflict").when(F.col("_s"), "linked").otherwise("open")
    every = v.join(sides, ends, "left")
    out = every.select("claim_id", outcome.alias("outcome"), "code", F.when(F.col("code").isNull() & F.col("_s"), link_id(application)).alias("link_id"))
    kinds = ("linked", "conflict", "rejected", "open")
    out = cut(out.observe(left, F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds]), "outcomes")
    counts = left.get
    if seen.get["n"] != counts["n"]:
        raise RuntimeError(f"{seen.get['n']} claims have {counts['n']} outcomes")

    one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    supported = good.where(side("supports")).join(sides.where("_s and not _c"), ends, "left_semi").groupBy(*ends).agg(
        F.min("tier").alias("tier"), merged("evidence_ids"), merged("methods"), merged("commit_shas"), merged("run_ids"), merged("artifact_ids"),
        F.max("captured_at").alias("last_confirmed_at"), F.array_sort(F.collect_set("explanation")).alias("_why"),
    )
    found = supported.select(
        link_id(application).alias("link_id"), *ends, "tier", F.when(F.size("methods") == 1, F.get("methods", F.lit(0))).otherwise(F.concat(F.lit("corroborated:"), F.array_join("methods", "+"))).alias("extraction_method"),
        F.substring(F.array_join("_why", " | "), 1, 4096).alias("explanation"), "evidence_ids", one("commit_shas").alias("commit_sha"), one("run_ids").alias("run_id"), one("artifact_ids").alias("artifact_id"),
        F.lit("not_required").alias("review_state"), F.lit(revision).alias("graph_revision"), "last_confirmed_at",
    )
    torn = good.join(sides.where("_s and _c"), ends, "left_semi").groupBy(*ends).agg(ids("supports").alias("supporting"), ids("contradicts").alias("contradicting"), merged("evidence_ids"))
    torn = torn.select(link_id(application).alias("link_id"), *ends, "supporting", "contradicting", "evidence_ids", F.lit("pending").alias("review_state"))
    return Linked(out, found, torn, ev.where("code is not null").select("evidence_id", "code"), {k: counts[k] for k in kinds})
