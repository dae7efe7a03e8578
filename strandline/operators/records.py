"""Slices of sources, listings of trees, holders of hits, roles, run control and dispositions of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.events import positions


def line_slice(df: DataFrame, ident: str, text: str, first: int, last: int, max_bytes: int) -> DataFrame:
    """(ident, slice, truncated): lines first to last (from 1), whole lines while their bytes and breaks fit."""
    lines = F.slice(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n"), "\n"), first, last - first + 1)
    d = df.select(ident, lines.alias("_l"))
    sizes = F.transform("_l", lambda x: F.octet_length(x) + 1)
    upto = F.transform(F.sequence(F.lit(1), F.size("_l")), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    fit = F.size(F.filter(F.when(F.size("_l") > 0, upto).otherwise(F.array().cast("array<int>")), lambda u: u <= max_bytes))
    return d.select(ident, F.array_join(F.slice("_l", F.lit(1), fit), "\n").alias("slice"), (fit < F.size("_l")).alias("truncated"))


def tree_entries(df: DataFrame, by: str, listing: str) -> DataFrame:
    """(by, mode, kind, sha, size, path) of NUL-separated listings of trees; entries that are none are left out."""
    shape = r"^(\d{6}) (blob|tree|commit) ([0-9a-f]{40,64})\s+(-|\d+)\t([\s\S]+)$"
    e = df.select(by, F.explode(F.split(listing, "\0")).alias("_e")).where(F.col("_e").rlike(shape))
    part = lambda k: F.regexp_extract("_e", shape, k)
    return e.select(by, part(1).alias("mode"), part(2).alias("kind"), part(3).alias("sha"), part(4).try_cast("bigint").alias("size"), part(5).alias("path"))


def preflight(entries: DataFrame, by: str, max_submodules: int, max_bytes: int) -> DataFrame:
    """Counts by tree and the first limit that it breaks."""
    blob, sub = F.col("kind") == "blob", F.col("kind") == "commit"
    g = entries.groupBy(by).agg(
        F.count_if(blob).alias("files"), F.coalesce(F.sum(F.when(blob, F.col("size"))), F.lit(0)).alias("bytes"),
        F.max(F.size(F.split("path", "/"))).alias("depth"), F.count_if(sub).alias("submodules"),
    )
    return g.withColumn("preflight", F.when(F.col("submodules") > max_submodules, "submodules").when(F.col("bytes") > max_bytes, "too_large").otherwise("accepted"))


def first_holder(points: DataFrame, ranges: DataFrame, by: str, at: str, start: str, end: str, name: str, ident: list[str], days: int) -> DataFrame:
    """(ident, name): the first range by name that holds each point; points and ranges meet by cells of some days."""
    cell = lambda c: F.floor(F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")) / days)
    r = ranges.select(by, start, end, name, F.explode(F.sequence(cell(start), cell(end))).alias("_cell"))
    hit = points.withColumn("_cell", cell(at)).join(r, [by, "_cell"]).where(F.col(at).between(F.col(start), F.col(end)))
    return hit.groupBy(*ident).agg(F.min(name).alias(name))


def with_role_edges(edges: DataFrame, roles: DataFrame, types: list[str]) -> DataFrame:
    """edges(from_id, type, to_id), and those of some types to a target with a role(to_id, role) once more as has_<role>."""
    again = edges.where(F.col("type").isin(types)).join(roles.where("role is not null"), "to_id")
    return edges.unionByName(again.select("from_id", F.concat(F.lit("has_"), "role").alias("type"), "to_id"))


#: The status after an action, by the statuses that allow it.
CONTROL = {"cancel": (("running", "paused", "pending"), "cancelled"), "retry": (("failed",), "queued"), "pause": (("running",), "paused"), "resume": (("paused",), "running")}


def control(runs: DataFrame, status: str, action: str) -> DataFrame:
    """Adds outcome: the status after the action, or rejected."""
    out: Column = F.lit(None)
    for a, (allowed, then) in CONTROL.items():
        out = F.coalesce(out, F.when((F.col(action) == a) & F.col(status).isin(*allowed), then))
    return runs.withColumn("outcome", F.coalesce(out, F.lit("rejected")))


def dispositions(reports: DataFrame, identity: list[str], head_of: str, arrival: list[str], at: str, payload: str) -> DataFrame:
    """Adds disposition: existing (its identity is there with this payload), conflict (with another), superseded (a newer
    report of its head is there) or published."""
    w = Window.partitionBy(*identity).orderBy(*arrival)
    first, head = reports.groupBy(*identity).agg(F.min_by(payload, F.struct(*arrival)).alias("_p")), reports.groupBy(head_of).agg(F.max(at).alias("_head"))
    d = reports.withColumn("_k", F.row_number().over(w)).join(first, identity).join(head, head_of)
    again = F.col("_k") > 1
    code = F.when(again & (F.col(payload) == F.col("_p")), "existing").when(again, "conflict").when(F.col(at) < F.col("_head"), "superseded").otherwise("published")
    return d.withColumn("disposition", code).drop("_k", "_p", "_head")


def within_total(df: DataFrame, order: list[str], size: str, limit: int) -> DataFrame:
    """The rows, in order over the whole table, before the running size first exceeds the limit; sums come from range blocks."""
    d = positions(df.withColumn("_all", F.lit(0)), ["_all"], order, F.col(size))
    return d.where(F.col("_end") <= limit).drop("_all", "_pos", "_size", "_end")
