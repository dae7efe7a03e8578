"""Explainable impact of a change: candidate paths, caveats, merged evidence, scored and ranked findings.

Input is one row by candidate path: candidate_id, seed_id, target_id, target_kind, title, operation, and arrays nodes
(id, kind, tier, review, application_id, revision) and hops (type, from_id, to_id, tier, review, application_id,
revision, stale, evidence_ids, conflict_ids). Nothing uncertain is dropped silently: a path with a caveat leaves the
findings and stays in the caveats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.tables import cut

MAX_HOPS = 10
TARGET_KINDS = ("ui-element", "screen", "workflow", "requirement")
#: Which steps a path may take, as (relationship, from kind, to kind, direction).
STEPS = (
    ("CALLS", "code-symbol", "code-symbol", "any"),
    ("READS", "code-symbol", "domain-entity", "any"),
    ("READS", "domain-entity", "code-symbol", "any"),
    ("WRITES", "code-symbol", "domain-entity", "any"),
    ("WRITES", "domain-entity", "code-symbol", "any"),
    ("CALLS_API", "code-symbol", "api-endpoint", "forward"),
    ("HANDLED_BY", "code-symbol", "api-endpoint", "reverse"),
    ("HANDLED_BY", "api-endpoint", "code-symbol", "forward"),
    ("BINDS", "code-symbol", "ui-element", "reverse"),
    ("RENDERED_BY", "code-symbol", "ui-element", "reverse"),
    ("RENDERED_BY", "code-symbol", "screen", "reverse"),
    ("MATCHES_ROUTE", "frontend-route", "screen", "reverse"),
    ("TRIGGERS_API", "api-endpoint", "ui-element", "reverse"),
    ("CONTAINS", "screen", "ui-element", "any"),
    ("CONTAINS", "ui-element", "screen", "any"),
    ("ACTS_ON", "ui-element", "flow-step", "reverse"),
    ("ON_SCREEN", "screen", "flow-step", "reverse"),
    ("NEXT", "flow-step", "flow-step", "any"),
    ("HAS_STEP", "flow-step", "workflow", "reverse"),
    ("COVERED_BY", "workflow", "requirement", "reverse"),
)
#: Points of changes and of criticalities.
CHANGE_POINTS = {"deleted": 3, "modified": 2, "added": 2, "renamed": 1, "moved": 1}
CRITICALITY_POINTS = {"critical": 4, "important": 3, "standard": 2, "peripheral": 1}


def _points(table: dict[str, int], c: Column, otherwise: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(otherwise))


def _steps_valid(steps: tuple) -> Column:
    allowed = F.array(*[F.lit("|".join(s)) for s in steps])

    def one(hop: Column, i: Column) -> Column:
        a, b = F.get("nodes", i), F.get("nodes", i + 1)
        way = F.when((hop["from_id"] == a["id"]) & (hop["to_id"] == b["id"]), "forward").when((hop["to_id"] == a["id"]) & (hop["from_id"] == b["id"]), "reverse")
        name = F.concat_ws("|", hop["type"], a["kind"], b["kind"])
        return way.isNotNull() & (F.array_contains(allowed, F.concat(name, F.lit("|"), way)) | F.array_contains(allowed, F.concat(name, F.lit("|any"))))

    return F.forall(F.transform("hops", one), lambda ok: F.coalesce(ok, F.lit(False)))


def caveats(candidates: DataFrame, application: str, revision: int, steps: tuple = STEPS, targets: tuple = TARGET_KINDS) -> DataFrame:
    """candidates with codes: the reasons, sorted by name, why a path proves nothing; empty if there are none. A candidate's
    own application_id and graph_revision count where it has them."""
    connected = F.forall(
        F.transform("hops", lambda h, i: ((h["from_id"] == F.get("nodes", i)["id"]) & (h["to_id"] == F.get("nodes", i + 1)["id"])) | ((h["to_id"] == F.get("nodes", i)["id"]) & (h["from_id"] == F.get("nodes", i + 1)["id"]))),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    unresolved = lambda x: x["review"].isin("pending", "rejected") | ((x["tier"] == "C") & (x["review"] != "accepted"))
    own = lambda name, wanted: F.col(name) != wanted if name in candidates.columns else F.lit(False)
    rules = {
        "foreign_application": own("application_id", application) | F.exists("nodes", lambda n: n["application_id"] != application) | F.exists("hops", lambda h: h["application_id"] != application),
        "stale_revision": own("graph_revision", revision) | F.exists("nodes", lambda n: n["revision"] != revision) | F.exists("hops", lambda h: (h["revision"] != revision) | h["stale"]),
        "depth_exceeded": F.size("hops") > MAX_HOPS,
        "cycle_detected": F.size(F.array_distinct(F.transform("nodes", lambda n: n["id"]))) < F.size("nodes"),
        "unsupported_target": ~F.col("target_kind").isin(*targets),
        "disconnected_path": ~connected,
        "invalid_direction": ~_steps_valid(steps),
        "tier_d_evidence": F.exists("nodes", lambda n: n["tier"] == "D") | F.exists("hops", lambda h: h["tier"] == "D"),
        "evidence_conflict": F.exists("hops", lambda h: F.size(h["conflict_ids"]) > 0),
        "review_unresolved": F.exists("nodes", unresolved) | F.exists("hops", unresolved),
    }
    return candidates.withColumn("codes", F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))))


def path_key() -> Column:
    """The address of a path: its ends, its nodes, and the relationships between them."""
    return F.sha2(F.concat_ws("|", F.col("seed_id").cast("string"), F.col("target_id").cast("string"), F.to_json(F.transform("nodes", lambda n: n["id"])), F.to_json(F.transform("hops", lambda h: F.struct(h["from_id"], h["to_id"], h["type"])))), 256)


def merged_paths(clean: DataFrame) -> DataFrame:
    """Candidates that walk the same nodes by the same relationships as one path with all their evidence.

    The strength of a candidate is its weakest tier, that of a path its strongest candidate's.
    """
    weakest = F.array_max(F.concat(F.transform("nodes", lambda n: n["tier"]), F.transform("hops", lambda h: h["tier"])))
    evidence = F.array_distinct(F.flatten(F.transform("hops", lambda h: h["evidence_ids"])))
    d = clean.withColumns({"path_key": path_key(), "_strength": weakest, "_evidence": evidence})
    return d.groupBy("path_key").agg(
        F.first("seed_id").alias("seed_id"), F.first("target_id").alias("target_id"), F.first("target_kind").alias("target_kind"), F.first("title").alias("title"), F.first(F.size("hops")).alias("hops"),
        F.min("_strength").alias("strength"), F.count_distinct("candidate_id").alias("candidates"), F.array_sort(F.collect_set("operation")).alias("operations"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_evidence")))).alias("evidence"),
    )


def findings(paths: DataFrame, criticalities: DataFrame) -> DataFrame:
    """One row by target with its factors, score, risk, strength and paths; criticalities has (target_id, criticality).

    Factors: the gravest change, criticality, the shortest path, the widest spread of a changed seed over targets (shared
    or not), and corroboration (two candidates on one path, with more evidence than hops).
    """
    paths = cut(paths, "paths")  # read for the spread and for the findings
    spread = paths.groupBy("seed_id").agg(F.count_distinct("target_id").alias("_spread"))
    per_op = F.array_max(F.transform("operations", lambda o: _points(CHANGE_POINTS, o, 0)))
    d = paths.join(spread, "seed_id").groupBy("target_id").agg(
        F.first("target_kind").alias("target_kind"), F.first("title").alias("title"), F.max(per_op).alias("change"), F.min("hops").alias("_depth"), F.max("_spread").alias("_spread"),
        F.max(((F.col("candidates") >= 2) & (F.col("evidence") > F.col("hops"))).cast("int")).alias("corroboration"), F.min("strength").alias("strength"), F.count("*").alias("paths"), F.count_distinct("seed_id").alias("seeds"),
    )
    d = d.join(criticalities, "target_id", "left").withColumn("criticality", F.coalesce("criticality", F.lit("standard")))
    d = d.withColumns({
        "criticality_points": _points(CRITICALITY_POINTS, F.col("criticality"), 2),
        "directness": F.when(F.col("_depth") <= 2, 3).when(F.col("_depth") <= 5, 2).otherwise(1),
        "breadth": F.when(F.col("_spread") >= 5, 3).when(F.col("_spread") >= 2, 2).otherwise(1),
        "shared": F.when(F.col("_spread") >= 2, 2).otherwise(0),
    })
    d = d.withColumn("score", reduce(Column.__add__, [F.col(c) for c in ("change", "criticality_points", "directness", "breadth", "shared", "corroboration")]))
    d = d.withColumn("risk", F.when(F.col("score") >= 10, "high").when(F.col("score") >= 6, "medium").otherwise("low"))
    return d.select("target_id", "target_kind", "title", "risk", "score", "strength", "criticality", "change", "criticality_points", "directness", "breadth", "shared", "corroboration", "paths", "seeds")


def scenarios(
    clean: DataFrame, found: DataFrame, workflow: str = "workflow", requirement: str = "requirement", checkpoints: tuple = ("ui-element", "screen", "flow-step", "workflow", "requirement"), limit: int = 100
) -> DataFrame:
    """What to verify for each path of a finding: (scenario_id, target_id, path_key, kind, workflow_id, requirement_id, checkpoint_ids, priority).

    One row by path of clean candidates whose target is in found(target_id, risk), at most limit a target (a report's size), the first by id. The
    workflow and the requirement are the first ones on the path (null: none), checkpoints the ids of all nodes of their kinds, in order.
    """
    first = lambda kind: F.get(F.transform(F.filter("nodes", lambda n: n["kind"] == kind), lambda n: n["id"]), F.lit(0))
    seen = F.array_sort(F.array_distinct(F.transform(F.filter("nodes", lambda n: n["kind"].isin(*checkpoints)), lambda n: n["id"])))
    kind = F.when(F.col("target_kind") == requirement, "requirement_acceptance").when(F.col("target_kind") == workflow, "workflow_checkpoint").otherwise("ui_interaction")
    d = clean.select(path_key().alias("path_key"), "target_id", kind.alias("kind"), first(workflow).alias("workflow_id"), first(requirement).alias("requirement_id"), seen.alias("checkpoint_ids")).dropDuplicates(["path_key"])
    d = d.join(found.select("target_id", F.col("risk").alias("priority")), "target_id")
    d = d.withColumn("scenario_id", F.sha2(F.to_json(F.struct("target_id", "path_key", "kind", "priority")).cast("binary"), 256))
    w = Window.partitionBy("target_id").orderBy("scenario_id")  # each task keeps its first rows before the shuffle
    d = d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit)
    return d.select("scenario_id", "target_id", "path_key", "kind", "workflow_id", "requirement_id", "checkpoint_ids", "priority")


def report_order(found: DataFrame) -> list[Column]:
    """By risk, score, strength of evidence, criticality and id."""
    rank = lambda c, *names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    return [rank("risk", "high", "medium", "low"), F.desc("score"), F.col("strength"), rank("criticality", *CRITICALITY_POINTS), F.col("target_id")]
