"""Rule tables and verdicts: checkpoints, coverage status, freshness, link policies, publication outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpoint_results(checkpoints: DataFrame, observations: DataFrame) -> DataFrame:
    """checkpoints(mission_id, checkpoint_id, operator, expected) with result: passed, failed, or blocked if it was not seen.

    observations has (mission_id, checkpoint_id, value, before). Operators: present, absent, equals, changed, unchanged,
    matches (a regular expression), status_in (a list by commas). Absent passes where nothing was seen.
    """
    d = checkpoints.join(observations.withColumn("_seen", F.lit(True)), ["mission_id", "checkpoint_id"], "left")
    v, e, o = F.col("value"), F.col("expected"), F.col("operator")
    ok = (
        F.when(o == "present", v.isNotNull()).when(o == "absent", v.isNull()).when(o == "equals", v.eqNullSafe(e)).when(o == "changed", ~v.eqNullSafe(F.col("before")))
        .when(o == "unchanged", v.eqNullSafe(F.col("before"))).when(o == "matches", F.regexp_like(v, e)).when(o == "status_in", F.array_contains(F.split(e, ","), v))
    )
    result = F.when(F.col("_seen").isNull() & (o != "absent"), "blocked").when(ok, "passed").otherwise("failed")
    return d.withColumn("result", result).drop("_seen")


def verdicts(results: DataFrame, by: str = "mission_id") -> DataFrame:
    """One row by mission: failed if anything failed, else blocked if anything was, else passed."""
    g = results.groupBy(by).agg(*[F.count_if(F.col("result") == r).alias(r) for r in ("passed", "failed", "blocked")])
    return g.withColumn("verdict", F.when(F.col("failed") > 0, "failed").when(F.col("blocked") > 0, "blocked").otherwise("passed"))


def coverage_status(requested: Column, blockers: Column, ambiguities: Column, expected: Column, observed: Column, attempts: Column) -> Column:
    """The status of a requirement by precedence; never a claim that something does not exist."""
    return (
        F.when(~requested, "not_evaluated").when(blockers > 0, "blocked").when(ambiguities > 0, "ambiguous").when((expected > 0) & (observed == expected), "observed")
        .when(observed > 0, "partially_observed").when(attempts > 0, "not_observed").otherwise("not_evaluated")
    )


def stale_reasons(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """The names, in order, of the revisions that differ, joined by commas."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(k)) for k, (a, b) in pairs.items()]))), ",")


def policy_met(links: DataFrame, methods: DataFrame, policy: DataFrame, link: str, relation: str) -> DataFrame:
    """(link, met): every clause of the relation's policy has one of its methods among the link's.

    policy has (relation, clause, method); methods has (link, method). A relation without a policy is met by any link.
    """
    clauses = links.join(policy.select(F.col("relation").alias(relation), "clause", "method"), relation)
    seen = clauses.join(methods.select(link, "method").distinct().withColumn("_hit", F.lit(1)), [link, "method"], "left")
    each = seen.groupBy(link, "clause").agg(F.max("_hit").alias("_hit"))
    short = each.where("_hit is null").select(link).distinct()
    return links.select(link).join(short.withColumn("_short", F.lit(True)), link, "left").select(link, F.col("_short").isNull().alias("met"))


def gaps(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(kind, id) of every gap, each once."""
    out = None
    for kind, df in checks:
        d = df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("string").alias("id")).distinct()
        out = d if out is None else out.unionByName(d)
    return out
