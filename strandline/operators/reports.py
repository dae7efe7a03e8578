"""Grouping of changes, seeds, case scores and stability of an evaluation, and reports as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.tables import cut, drop, forget
from strandline.operators import events, graphs, summaries


def group_changes(units: DataFrame, unit: str, keys: DataFrame, size: str, limit: float) -> DataFrame:
    """(unit, component, chunk): units that share a key, directly or through others, in chunks of bounded size.

    keys has (unit, key); nulls are shared by nobody. A unit is at home at its least key, which stands for it: its other keys are linked to
    this one and components are found among keys only. A key that many units share costs one edge for each unit at most, not one for each pair.
    Keys are whole numbers, or hashes of what they are. Steps are written and let go of one after another, and rows are dealt to tasks by number.
    """
    spark, whole = keys.sparkSession, dict(keys.dtypes)["key"] in ("tinyint", "smallint", "int", "bigint")
    k = keys.select(unit, (F.col("key").cast("bigint") if whole else F.when(F.col("key").isNotNull(), F.xxhash64("key"))).alias("_key")).dropna()
    tasks = k.count() // graphs.EDGES_OF_A_TASK + 1
    k = k.repartition(tasks, unit)
    low = k.groupBy(unit).agg(F.min("_key").alias("_home"))
    links = cut(k.join(low.hint("shuffle_hash"), unit).where("_key <> _home").select(F.col("_home").alias("src"), F.col("_key").alias("dst")), "key-links")
    step = lambda *old: (drop(*old), tasks > 1 and forget(spark))
    step()
    d = cut(units.select(unit, size).repartition(tasks, unit).join(low.hint("shuffle_hash"), unit, "left"), "homes")
    step()
    found = graphs.components(links)
    parts = cut(found, "key-components")
    step(links, found)
    comp = parts.withColumnRenamed("id", "_home")
    homes = d.where("_home is not null").repartition(tasks, "_home").groupBy("_home").agg(F.min(unit).alias("_first"))
    homes = homes.join(comp.repartition(tasks, "_home").hint("shuffle_hash"), "_home", "left").select("_home", F.coalesce("component", "_home").alias("_c"), "_first")
    named = cut(homes, "named")
    step(parts)
    first = named.repartition(tasks, "_c").groupBy("_c").agg(F.min("_first").alias("component"))  # a component is named by its smallest unit
    first = named.repartition(tasks, "_c").join(first.hint("shuffle_hash"), "_c").select("_home", "component")
    grouped = d.where("_home is not null").repartition(tasks, "_home").join(first.repartition(tasks, "_home").hint("shuffle_hash"), "_home").select(unit, "component", size)
    grouped = cut(grouped.union(d.where("_home is null").select(unit, F.col(unit).alias("component"), size)), "grouped")
    step(d, named)
    return events.range_chunks(grouped, ["component"], [unit], size, limit).select(unit, "component", "chunk")


def seed_ranks(sources: list[tuple[int, DataFrame]], ident: str, limit: int | None = None) -> DataFrame:
    """(ident, rank): the best rank of every seed over several sources; the first limit by (rank, id) where asked."""
    out = None
    for rank, df in sources:
        d = df.select(F.col(ident), F.lit(rank).alias("rank"))
        out = d if out is None else out.unionByName(d)
    out = out.groupBy(ident).agg(F.min("rank").alias("rank"))
    return out.orderBy("rank", ident).limit(limit) if limit is not None else out


def case_scores(metrics: DataFrame, by: list[str], names: list[str], lower: set[str]) -> DataFrame:
    """by, score: the mean of the metrics, those where less is better turned round."""
    turned = [1 - F.col(n) if n in lower else F.col(n) for n in names]
    return metrics.select(*by, (sum(turned[1:], turned[0]) / len(names)).alias("score"))


def metric_distributions(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row by metric with its distribution; metrics are unpivoted once, so all come from one pass."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")
    return summaries.distribution(long, "metric", "value")


def citation_accuracy(expected: DataFrame, cited: DataFrame, case: str, ident: str) -> DataFrame:
    """(case, exact): whether the cited ids are exactly the expected ones, as sets."""
    c = summaries.classify(expected, cited, case, ident)
    return c.select(case, ((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"))


def markdown_report(findings: DataFrame, order: list, sections: list[tuple[str, Column]]) -> DataFrame:
    """(section, line, text): findings as list items under the first section whose condition holds, in order.

    Lines stay rows, numbered within their section by range blocks, so a report of any size is written by Spark.
    """
    which = F.coalesce(*[F.when(c, F.lit(i)) for i, (_, c) in enumerate(sections)])
    d = findings.withColumn("section", which).where("section is not null")
    text = F.format_string("- **%s** (%s): %s risk, score %s, evidence %s", "title", "target_kind", "risk", F.col("score").cast("string"), "strength")
    items = events.positions(d, ["section"], order).select("section", F.col("_pos").cast("int").alias("line"), text.alias("text"))
    heads = findings.sparkSession.createDataFrame([(i, 0, f"## {n}") for i, (n, _) in enumerate(sections)], "section int, line int, text string")
    return heads.unionByName(items)


def check_outcome(findings: DataFrame) -> DataFrame:
    """One row: counts by risk and the outcome of a check, by precedence."""
    g = findings.agg(*[F.count_if(F.col("risk") == r).alias(r) for r in ("high", "medium", "low")])
    return g.withColumn("outcome", F.when(F.col("high") > 0, "action_required").when(F.col("medium") > 0, "neutral").otherwise("success"))
