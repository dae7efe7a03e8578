"""Missions, verification, budgets and event feeds: plans, results, ledgers, reducers and projections."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan(scenarios: DataFrame, definitions: DataFrame, controls: DataFrame, limit: int = 10) -> DataFrame:
    """(kind, ordinal, id, priority, findings): the missions of a verification plan.

    scenarios has (finding_id, risk, scenario_id, workflow_id), a row by finding; a scenario's priority is its best risk.
    Scenarios with a definition(scenario_id) and a workflow are affected missions, the first limit by priority and id. The
    control is the first of controls(id, workflow_id) whose workflow no scenario touches; it comes last.
    """
    rank = F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).otherwise(2)
    known = scenarios.where("risk <> 'unknown'")
    s = known.groupBy("scenario_id").agg(F.min(rank).alias("p"), F.max("workflow_id").alias("workflow_id"), F.count_distinct("finding_id").alias("findings"))
    eligible = s.where("workflow_id is not null").join(definitions.select("scenario_id").distinct(), "scenario_id", "left_semi")
    first = eligible.orderBy("p", "scenario_id").limit(limit)
    affected = first.select(F.lit("affected").alias("kind"), F.col("scenario_id").alias("id"), "p", "findings")
    free = controls.join(known.select("workflow_id").distinct(), "workflow_id", "left_anti").groupBy().agg(F.min("id").alias("id")).where("id is not null")
    control = free.select(F.lit("control").alias("kind"), "id", F.lit(2).alias("p"), F.lit(0).cast("bigint").alias("findings"))
    w = Window.orderBy("kind", "p", "id")  # limit + 1 rows
    names = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low")]), F.col("p") + 1)
    return affected.unionByName(control).select("kind", (F.row_number().over(w) - 1).alias("ordinal"), "id", names.alias("priority"), "findings")


def effective_results(results: DataFrame, assertions: DataFrame) -> DataFrame:
    """Results(run_id, mission_id, kind, status, category) without the missions that an agent blocked and whose blocked
    checkpoints the follow-up of the run all passed; assertions has (mission_id, checkpoint_id, outcome)."""
    up = results.where("kind = 'followup' and status in ('passed', 'behavior_changed')").select("run_id", "mission_id")
    solved = up.join(assertions.where("outcome = 'passed'"), "mission_id").select("run_id", "checkpoint_id").distinct().withColumn("_ok", F.lit(1))
    blocked = results.where("kind <> 'followup' and status = 'blocked' and category = 'agent_block'").select("run_id", "mission_id")
    b = blocked.join(assertions.where("outcome = 'blocked'").select("mission_id", "checkpoint_id"), "mission_id")
    gone = b.join(solved, ["run_id", "checkpoint_id"], "left").groupBy("mission_id").agg(F.count("*").alias("n"), F.count("_ok").alias("k")).where("n = k")
    return results.join(gone.select("mission_id"), "mission_id", "left_anti")


def retention(artifacts: DataFrame, now: Column, failure_seconds: int, report_seconds: int, success_seconds: int) -> DataFrame:
    """Artifacts(artifact_id, purpose, status) with disposition, reason and delete_after."""
    failed, report = F.col("status").isin("failed", "blocked"), F.col("purpose") == "report"
    keep = failed | report | F.lit(success_seconds > 0)
    seconds = F.when(failed, failure_seconds).when(report, report_seconds).otherwise(success_seconds)
    reason = F.when(failed, "failure_evidence").when(keep, "report_evidence").otherwise("successful_run")
    until = F.when(keep, F.timestamp_seconds(F.unix_timestamp(now) + seconds).cast("timestamp_ntz"))
    return artifacts.select("artifact_id", F.when(keep, "retain").otherwise("delete").alias("disposition"), reason.alias("reason"), until.alias("delete_after"))


def keep_until(existing: DataFrame, changes: DataFrame, key: str, until: str) -> DataFrame:
    """Retention that only grows: the latest of what is there (null: nothing yet) and what changes ask for."""
    c = changes.groupBy(key).agg(F.max(until).alias("_u"))
    return existing.join(c, key, "left").select(key, F.greatest(until, "_u").alias(until))


def ledger(entries: DataFrame, run: str, entry: str, order: list[str], amounts: list[str]) -> DataFrame:
    """Sums by run of the last version of each entry."""
    last = entries.groupBy(run, entry).agg(F.max_by(F.struct(*amounts), F.struct(*order)).alias("_r"))
    return last.groupBy(run).agg(F.count("*").alias("entries"), *[F.sum(f"_r.{a}").alias(a) for a in amounts])


def reduce_by_key(rows: DataFrame, key: list[str], content: Column) -> DataFrame:
    """(key, versions, conflict): equal rows of a key merge, different ones are a conflict; nulls are equal to nulls only."""
    h = rows.groupBy(*key, content.alias("_content")).agg(F.count("*").alias("_n"))
    return h.groupBy(*key).agg(F.sum("_n").alias("versions"), (F.count("*") > 1).alias("conflict"))


def complete_traversal(pages: DataFrame, by: str, order: str, cursor: str, next_cursor: str) -> DataFrame:
    """(by, complete): every page starts at the cursor that the one before it gave, none repeats, the last gives none."""
    w = Window.partitionBy(by).orderBy(order)
    d = pages.withColumn("_before", F.lag(next_cursor).over(w)).withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead(order).over(w).isNull())
    ok = F.when(F.col("_first"), F.col(cursor).isNull()).otherwise(F.coalesce(F.col(cursor) == F.col("_before"), F.lit(False))) & (~F.col("_last") | F.col(next_cursor).isNull())
    once = F.count(cursor) == F.count_distinct(cursor)
    return d.groupBy(by).agg(F.bool_and(ok).alias("_ok"), once.alias("_once")).select(by, (F.col("_ok") & F.col("_once")).alias("complete"))


def journeys(transitions: DataFrame, by: str, order: list[str], history: Column) -> DataFrame:
    """Adds journey: transitions are cut before each step back or reload, which belongs to no journey itself."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = transitions.withColumn("_back", history).withColumn("journey", F.count_if("_back").over(w))
    return d.where("not _back").drop("_back")


def accept_versions(appends: DataFrame, by: str, order: list[str], version: str, payload: str) -> DataFrame:
    """Adds outcome of each append in order of arrival: appended (one more than the versions so far), repeated (a version
    that is there, with its payload), conflict (with another), or gap. Rows with a null key are a group.

    Each append depends on all before it of its group, so a group is read in order by one task, which keeps a digest a version.
    """
    digest = lambda p: hashlib.blake2b(repr(p).encode(), digest_size=16).digest()

    def run(batches):
        now, there = object(), []  # no key yet
        for b in batches:
            out = []
            for key, v, p in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in (by, version, payload)]):
                if key != now:
                    now, there = key, []
                if v == len(there) + 1:
                    there.append(digest(p))
                    out.append("appended")
                elif v is not None and 1 <= v <= len(there):
                    out.append("repeated" if there[v - 1] == digest(p) else "conflict")
                else:
                    out.append("gap")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "outcome"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in appends.schema)
    return appends.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, f"{schema}, outcome string")


def deliveries(rows: DataFrame, ident: str, key: str, updated: str, arrival: list[str]) -> DataFrame:
    """(ident, outcome, is_current) of deliveries in order of arrival: duplicate (the id came before), stale (a newer one of
    its key came before) or new; the newest of a key is current."""
    again = F.row_number().over(Window.partitionBy(ident).orderBy(*arrival)) > 1
    d = rows.withColumn("_again", again)
    w = Window.partitionBy(key, "_again").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_newest", F.max(updated).over(w))
    top = d.where("not _again").groupBy(key).agg(F.max_by(ident, F.struct(updated, *arrival)).alias("_top"))
    outcome = F.when(F.col("_again"), "duplicate").when(F.col("_newest") > F.col(updated), "stale").otherwise("new")
    return d.join(top, key).select(ident, outcome.alias("outcome"), (~F.col("_again") & (F.col(ident) == F.col("_top"))).alias("is_current"))


def feed(events: DataFrame, by: str, lane: Column, order: list[str], status: str, cost: str) -> DataFrame:
    """(by, lane, events, status, spent): an activity feed's lanes with their newest status and cost."""
    d = events.withColumn("lane", lane)
    return d.groupBy(by, "lane").agg(F.count("*").alias("events"), F.max_by(status, F.struct(*order)).alias("status"), F.sum(cost).alias("spent"))
