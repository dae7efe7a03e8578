"""Unified diffs as tables: files, changed lines with both sides' numbers, and merged line ranges.

Patches come as (pr_id, patch). Lines are split and numbered in the JVM; what a line means is found by looking back in
its patch (last header seen), and line numbers by running sums from its hunk's header on, so a long patch is one ordered
group of its own pull request, sorted once, and no more.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.tables import cut
from strandline.operators import events

#: Characters of patches that a task is given.
CHARS_OF_A_TASK = 1 << 24


def _dealt(patches: DataFrame) -> DataFrame:
    """(pr_id, at, row) of every line. Patches are dealt by their length first: they pack so well that a task which split what it was given held
    tens of millions of lines. What follows stays by pr_id and needs no other shuffle."""
    p = cut(patches.select("pr_id", "patch"), "patches")
    chars = p.agg(F.sum(F.length("patch"))).first()[0] or 0
    return p.repartition(chars // CHARS_OF_A_TASK + 1, "pr_id").select("pr_id", F.posexplode(F.split("patch", "\n")).alias("at", "row"))


def diff_lines(patches: DataFrame) -> DataFrame:
    """(pr_id, file, old_path, new_path, side, line, content) of every added and removed line."""
    row, pattern = F.col("row"), r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    number = lambda n: F.when(F.col("is_header"), F.regexp_extract("row", pattern, n).cast("int"))
    kind = F.when(row.startswith("+"), "head").when(row.startswith("-"), "base").when(row.startswith(" "), "context")
    d = _dealt(patches).withColumn("is_file", row.startswith("diff --git ")).withColumn("is_header", row.rlike(pattern))
    d = d.select("pr_id", "at", "is_file", "is_header", kind.alias("_kind"), number(1).alias("_b"), number(2).alias("_h"), F.substring("row", 2, 1 << 30).alias("content"))
    w = Window.partitionBy("pr_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    d = d.withColumn("file", F.sum(F.col("is_file").cast("int")).over(w)).withColumn("_open", last(F.when(F.col("is_file"), False).when(F.col("is_header"), True)))
    d = d.withColumn("side", F.when(F.col("_open") & ~F.col("is_header"), F.col("_kind")))
    of = lambda k: F.sum(F.coalesce(F.col("side").isin(k, "context"), F.lit(False)).cast("int")).over(w)
    d = d.withColumn("_base", of("base")).withColumn("_head", of("head"))
    start = F.struct((F.col("_b") - 1 - F.col("_base")).alias("b"), (F.col("_h") - 1 - F.col("_head")).alias("h"))
    d = d.withColumn("_from", last(F.when(F.col("is_header"), start))).where("side in ('base', 'head')")
    return d.select("pr_id", "file", "side", F.when(F.col("side") == "base", F.col("_from.b") + F.col("_base")).otherwise(F.col("_from.h") + F.col("_head")).alias("line"), "content")


def diff_files(patches: DataFrame) -> DataFrame:
    """(pr_id, file, operation, old_path, new_path, similarity, binary) of every file of a patch."""
    row = F.col("row")
    is_file, is_hunk = row.startswith("diff --git "), row.startswith("@@ ")
    said = [row.startswith(x) for x in ("rename ", "copy ", "similarity index ", "new file mode", "deleted file mode", "Binary files ", "GIT binary patch")]
    d = _dealt(patches).where(reduce(or_, said, is_file | is_hunk))  # no other line tells about a file
    w = Window.partitionBy("pr_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("file", F.sum(is_file.cast("int")).over(w)).withColumn("_open", F.last(F.when(is_file, False).when(is_hunk, True), ignorenulls=True).over(w)).where("file > 0 and not _open")
    found = lambda p, n=1: F.max(F.when(F.col("row").rlike(p), F.regexp_extract("row", p, n)))
    g = d.groupBy("pr_id", "file").agg(
        found(r'^diff --git "?a/(.*?)"? "?b/(.*?)"?$').alias("_a"), found(r'^diff --git "?a/(.*?)"? "?b/(.*?)"?$', 2).alias("_b"),
        found(r"^rename from (.*)$").alias("_from"), found(r"^rename to (.*)$").alias("_to"), found(r"^copy from (.*)$").alias("_cfrom"), found(r"^copy to (.*)$").alias("_cto"),
        found(r"^similarity index (\d+)%$").alias("_sim"), F.bool_or(F.col("row").startswith("new file mode")).alias("_new"), F.bool_or(F.col("row").startswith("deleted file mode")).alias("_gone"),
        F.bool_or(F.col("row").startswith("Binary files ") | F.col("row").startswith("GIT binary patch")).alias("binary"),
    )
    op = F.when(F.col("_from").isNotNull(), "renamed").when(F.col("_cfrom").isNotNull(), "copied").when(F.col("_new"), "added").when(F.col("_gone"), "deleted").otherwise("modified")
    return g.select(
        "pr_id", "file", op.alias("operation"), F.when(~F.col("_new"), F.coalesce("_from", "_cfrom", "_a")).alias("old_path"), F.when(~F.col("_gone"), F.coalesce("_to", "_cto", "_b")).alias("new_path"), F.col("_sim").cast("int").alias("similarity"), "binary"
    )


def diff_ranges(lines: DataFrame) -> DataFrame:
    """(pr_id, file, side, first, last) of runs of consecutive changed lines."""
    return events.islands(lines, ["pr_id", "file", "side"], "line")
