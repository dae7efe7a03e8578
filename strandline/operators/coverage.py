"""The coverage matrix: what a graph of requirements, workflows, endpoints and code leaves without evidence, and whether it is ready.

entities: (id, kind, evidence_ids, behavioral, changed); links: (id, from_id, to_id, relationship, tier, review_state, evidence_ids); stale: (evidence_id);
conflicts: (id, from_id, to_id); candidates: (id, from_id, to_id, disposition); reviewed: (target_kind, target_id). Null flags are false, null arrays empty.
Whether an entity reaches a kind is answered for all entities by one search back from that kind, so a search holds each node once; the
searches go level by level together, and rows are dealt to tasks by number. Each step is written by itself; what no later step reads is deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.tables import cut, dealt_groups, drop, forget, shuffled_joins
from strandline.operators import graphs, links as lk

#: The relationships of a way through the implementation, and of one to what the product is meant to do.
TECHNICAL = ("HAS_STEP", "NEXT", "ON_SCREEN", "ACTS_ON", "CONTAINS", "MATCHES_ROUTE", "RENDERED_BY", "BINDS", "TRIGGERS_API", "CALLS_API", "HANDLED_BY", "CALLS", "READS", "WRITES")
INTENT = (*TECHNICAL, "COVERED_BY", "STATES", "REQUIRES")
SCREENS = ("HAS_STEP", "NEXT", "ON_SCREEN", "ACTS_ON")
#: Parts, by id, in which links that do not fit one task are held against what takes their place.
PARTS_OF_LINKS = 4
#: Who can close a gap of a kind; nobody but a human the others.
AGENTS = {
    "requirement_without_workflow": "application", "workflow_without_ui": "application", "workflow_without_code": "code", "endpoint_without_code": "code", "code_without_intent": "documentation",
    "changed_symbol_without_product_path": "code", "stale_evidence": "documentation",
}


def confident_links(links: DataFrame, stale: DataFrame) -> DataFrame:
    """(from_id, to_id, relationship) of links that count: a pending one in place of the current one of its id, no stale evidence, tier and review as
    links.confident asks (column confident)."""
    tasks = links.count() // graphs.EDGES_OF_A_TASK + 1
    gone = _resting(links, stale).select("id", "pending").union(links.where("pending").select("id", F.lit(False)))
    good = links.where("confident").select("id", "pending", "from_id", "to_id", "relationship").repartition(tasks, "id", "pending")
    return good.join(gone.repartition(tasks, "id", "pending").hint("shuffle_hash"), ["id", "pending"], "left_anti").select("from_id", "to_id", "relationship")


def _resting(d: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows of d that rest on stale evidence, once for each of it."""
    return d.withColumn("evidence_id", F.explode("evidence_ids")).join(stale, "evidence_id", "left_semi")


def matrix(entities: DataFrame, current: DataFrame | list[DataFrame], pending: DataFrame, stale: DataFrame, conflicts: DataFrame, candidates: DataFrame, reviewed: DataFrame, depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """Gaps (kind, subject_id, target_id, gap_id, requires_human, agent), and one row of stats with the readiness.

    A gap of stale evidence has a row for each entity or link end that rests on it (one row without a subject if nothing does) and counts as one gap.
    Conflicts and candidates name both ends; they are human gaps until reviewed, candidates also if they were rejected.
    Current links may come in several tables, which are worked out one after another.
    """
    with shuffled_joins(entities.sparkSession):
        return _matrix(entities, current, pending, stale, conflicts, candidates, reviewed, depth)


def _matrix(entities: DataFrame, current: DataFrame | list[DataFrame], pending: DataFrame, stale: DataFrame, conflicts: DataFrame, candidates: DataFrame, reviewed: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    e, stale = cut(entities, "entities"), cut(stale.select("evidence_id").where("evidence_id is not null").distinct(), "stale")
    if stale.count() <= graphs.IDS_OF_A_BROADCAST:
        stale = F.broadcast(stale)  # evidence that very many rows rest on is no hot key then
    sure = F.coalesce(lk.confident(F.col("tier"), F.col("review_state"), F.lit(False)), F.lit(False)).alias("confident")
    side = lambda d, waits: d.select("id", "from_id", "to_id", "relationship", "evidence_ids", sure, F.lit(waits).alias("pending"))
    spark, every = e.sparkSession, lambda tables: reduce(DataFrame.union, tables)
    written, n = [], 0
    for d in [side(d, False) for d in (current if isinstance(current, list) else [current])] + [side(pending, True)]:
        written.append(cut(d, "links"))
        n += written[-1].count()
        if n > graphs.EDGES_OF_A_TASK:
            forget(spark)
    links, tasks = every(written), (n + e.count()) // graphs.EDGES_OF_A_TASK + 1
    done = lambda *old: (drop(*old), tasks > 1 and forget(spark))
    rested = _resting(e, stale).select("id").union(_resting(links, stale).select(F.explode(F.array("from_id", "to_id")).alias("id")))
    with dealt_groups(spark, tasks):
        subjects = cut(rested.where("id is not null").distinct(), "stale-subjects")
    done()
    kept = []
    for k in range(parts := PARTS_OF_LINKS if tasks > 1 else 1):
        kept.append(cut(confident_links(links.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k), stale), "confident"))
        done()
    good = every(kept)
    done(*written)

    searches = {  # by the gap that is left where it does not arrive: the kinds it starts at, its relationships and depth
        "workflow_without_ui": (("screen", "ui-element"), SCREENS, 4),
        "workflow_without_code": (("code-symbol",), TECHNICAL, depth),
        "code_without_intent": (("requirement",), INTENT, depth),
        "changed_symbol_without_product_path": (("requirement", "workflow", "screen", "ui-element"), INTENT, depth),
    }
    ends = {"requirement_without_workflow": ("from_id", "COVERED_BY"), "endpoint_without_code": ("from_id", "HANDLED_BY"), "moved": ("to_id", "CHANGES")}
    bit = {name: 1 << k for k, name in enumerate([*searches, *ends])}
    which = lambda column, part: sum((F.when(F.col(column).isin(*s[part]), bit[gap]).otherwise(0) for gap, s in searches.items()), F.lit(0)).alias("searches")
    ways = [graphs.symmetrise(d.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), which("relationship", 1))) for d in kept]
    marks = graphs.reached(ways, e.select("id", which("kind", 0)), [within for _, _, within in searches.values()])
    for name, (end, relationship) in ends.items():
        marks = marks.union(good.where(F.col("relationship") == relationship).select(F.col(end).alias("id"), F.lit(bit[name])))
    with dealt_groups(spark, tasks):
        marks = cut(marks.groupBy("id").agg(F.bit_or("searches").alias("marks")), "marks")
    confident = good.count()
    done(*kept)

    has = lambda name: F.coalesce("marks", F.lit(0)).bitwiseAND(F.lit(bit[name])) != 0
    symbol = (F.col("kind") == "code-symbol") & F.col("behavioral")
    asks = {
        "requirement_without_workflow": F.col("kind") == "requirement", "workflow_without_ui": F.col("kind") == "workflow", "workflow_without_code": F.col("kind") == "workflow",
        "endpoint_without_code": F.col("kind") == "api-endpoint", "code_without_intent": symbol, "changed_symbol_without_product_path": symbol & (F.coalesce("changed", F.lit(False)) | has("moved")),
    }
    row = lambda d, kind, subject, target, gap, human, agent: d.select(kind.alias("kind"), subject.cast("string").alias("subject_id"), target.cast("string").alias("target_id"), gap.cast("string").alias("gap_id"), F.lit(human).alias("requires_human"), agent.cast("string").alias("agent"))
    nobody, ident, kind = F.lit(None), F.col("id"), F.col("gap")
    marked = e.repartition(tasks, "id").join(marks.repartition(tasks, "id").hint("shuffle_hash"), "id", "left")
    open_ = marked.select("id", F.explode(F.array_compact(F.array(*[F.when(asked & ~has(gap), gap) for gap, asked in asks.items()]))).alias("gap")).distinct()
    agent = F.create_map(*[F.lit(x) for pair in AGENTS.items() for x in pair])
    gaps = row(open_, kind, ident, nobody, F.concat(kind, F.lit(":"), ident), False, agent[kind])
    waiting = lambda d, what: d.join(reviewed.where(F.col("target_kind") == what).select(F.col("target_id").alias("id")), "id", "left_anti")
    human = lambda d, gap, prefix: row(d.select("id", "from_id", "to_id").distinct(), F.lit(gap), F.col("from_id"), F.col("to_id"), F.concat(F.lit(prefix), ident), True, nobody)
    gaps = gaps.union(human(waiting(conflicts, "conflict"), "conflict", "conflict:"))
    gaps = gaps.union(human(waiting(candidates.where("disposition is null or disposition <> 'rejected'"), "candidate"), "human_review_required", "candidate:"))
    some = subjects if not subjects.isEmpty() else stale.limit(1).select(F.lit(None).cast("string").alias("id"))
    gaps = cut(gaps.union(row(some, F.lit("stale_evidence"), ident, nobody, F.lit("stale_evidence"), False, F.lit(AGENTS["stale_evidence"]))), "gaps")
    done(subjects, marks)

    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"{kind.replace('-', '_')}s")
    once = lambda d: d.groupBy("gap_id").agg(F.max("requires_human").alias("h"))
    ids, old = gaps.select("kind", "gap_id", "requires_human"), F.col("kind") == "stale_evidence"  # these rows are one gap
    found = once(ids.where(~old).repartition(gaps.count() // graphs.EDGES_OF_A_TASK + 1, "gap_id")).union(once(ids.where(old))).agg(F.count("*").alias("gaps"), F.count_if("h").alias("human_gaps"))
    stats = e.agg(F.count("*").alias("entities"), *[count(k) for k in ("requirement", "workflow", "api-endpoint", "code-symbol")])
    stats = stats.withColumn("confident_links", F.lit(confident).cast("bigint")).crossJoin(found)  # two rows of counts
    return gaps, stats.withColumn("readiness", F.when(F.col("gaps") == 0, "ready").when(F.col("human_gaps") > 0, "needs_human").otherwise("needs_reconciliation"))
