"""What a change of sources means for a graph: which entities it affects and why, and what becomes of links and requirements.

entities: (id, kind, source_paths, depends_on_ids, stale); links: (id, from_id, to_id, relationship, review_state, source_paths); changed:
(path). Null arrays are empty and null flags false; a null id is nothing that others can depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.tables import cut
from strandline.operators import graphs
from strandline.operators.rows import tasks_for

#: Up to so many changed paths are given to every task.
PATHS_OF_A_BROADCAST = 1 << 16


def ancestors(path: Column) -> Column:
    """The path itself and all folders above it: a/b/c, a/b, a."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def touched(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """(id) of rows(id, source_paths) with a source that is a changed path, lies under one, or holds one.

    Paths meet as whole strings: each side is exploded into its own folders, which the other side's full paths are compared with.
    """
    own = rows.select("id", F.explode("source_paths").alias("p")).where("p is not null")
    c = changed.select(F.col("path").alias("p")).where("p is not null").distinct()
    tasks, few = tasks_for(rows), c.count() <= PATHS_OF_A_BROADCAST
    held = lambda d: F.broadcast(d) if few else d.repartition(tasks, "p").hint("shuffle_hash")  # noqa: E731  # many rows may share a path, so those are never sorted by it
    dealt = lambda d: d if few else d.repartition(tasks, "p")
    under = dealt(own.select("id", F.explode(ancestors(F.col("p"))).alias("p"))).join(held(c), "p", "left_semi")
    above = dealt(own).join(held(c.select(F.explode(ancestors(F.col("p"))).alias("p")).distinct()), "p", "left_semi").select("id")
    return under.select("id").union(above).repartition(tasks, "id").distinct()


def affected(entities: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, hop, reason, via) of entities that are stale, have a changed source, or depend on one that is affected, directly or not."""
    ids = lambda d, reason: d.select("id", F.lit(reason).alias("reason"))
    seeds = ids(touched(entities, changed), "source_changed").union(ids(entities.where("stale"), "stale"))
    depends = entities.select("id", F.explode("depends_on_ids").alias("on_id"), F.lit("depends_on_affected").alias("reason"))
    return graphs.closure_with_reasons(depends, seeds)


def plan(entities: DataFrame, links: DataFrame, changed: DataFrame) -> DataFrame:
    """(subject, id, outcome, reason, hop): every entity (affected or reused), every link (invalidated, reusable if accepted, else
    unreviewed), and the requirements to assess again.

    A link is invalidated by its end or its own source, in this order. A requirement is assessed again if it is affected, if an
    affected workflow depends on it, or if a COVERED_BY link leads from it to an affected workflow; the first of these is the reason.
    """
    entities = cut(entities.select("id", "kind", "source_paths", "depends_on_ids", "stale"), "entities")
    links = cut(links.select("id", "from_id", "to_id", "relationship", "review_state", "source_paths"), "links")
    hit = cut(affected(entities, changed), "affected")
    tasks = tasks_for(entities, links)
    by = lambda df, key: df.repartition(tasks, key)
    held = lambda df, key: by(df, key).hint("shuffle_hash")  # noqa: E731  # a task holds its share of this side, and sorts neither
    known = hit.select("id", "hop", "reason")
    e = by(entities.select("id", "kind"), "id").join(held(known, "id"), "id", "left")
    subjects = e.select(F.lit("entity").alias("subject"), F.col("id").cast("string").alias("id"), F.when(F.col("hop").isNull(), "reused").otherwise("affected").alias("outcome"), "reason", "hop")

    li = links.select("id", "from_id", "to_id", "review_state")
    for side in ("from_id", "to_id"):
        li = by(li, side).join(held(hit.select(F.col("id").alias(side), F.lit(True).alias(f"_{side}")), side), side, "left")
    li = by(li, "id").join(held(touched(links, changed).withColumn("_source", F.lit(True)), "id"), "id", "left")
    why = F.when(F.col("_from_id"), "from_affected").when(F.col("_to_id"), "to_affected").when(F.col("_source"), "source_changed")
    outcome = F.when(why.isNotNull(), "invalidated").when(F.col("review_state") == "accepted", "reusable").otherwise("unreviewed")
    dispositions = li.select(F.lit("link").alias("subject"), F.col("id").cast("string").alias("id"), outcome.alias("outcome"), why.alias("reason"), F.lit(None).cast("int").alias("hop"))

    flows = by(entities.where("kind = 'workflow'").select("id", "depends_on_ids"), "id").join(held(known.select("id"), "id"), "id", "left_semi")
    again = known.select("id", F.lit(0).alias("_rank")).union(flows.select(F.explode("depends_on_ids").alias("id"), F.lit(1)))
    covered = by(links.where("relationship = 'COVERED_BY'").select("from_id", "to_id"), "to_id").join(held(flows.select(F.col("id").alias("to_id")), "to_id"), "to_id", "left_semi")
    again = by(again.union(covered.select("from_id", F.lit(2))), "id").groupBy("id").agg(F.min("_rank").alias("_rank"))
    again = again.join(held(entities.where("kind = 'requirement'").select("id"), "id"), "id", "left_semi").join(held(known.select("id", "hop"), "id"), "id", "left")
    reason = F.element_at(F.array(*[F.lit(x) for x in ("affected", "workflow_depends_on_it", "covered_by_workflow")]), F.col("_rank") + 1)
    assess = again.select(F.lit("requirement").alias("subject"), F.col("id").cast("string").alias("id"), F.lit("reassess").alias("outcome"), reason.alias("reason"), "hop")
    return subjects.union(dispositions).union(assess)
