"""Aggregations: zero-filled counts, claims, classification ratios, exact distributions, budgets, module trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(members: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(key, n) for every member of an enumeration, 0 where there is no fact."""
    counts = facts.groupBy(key).agg(F.count("*").alias("n"))
    return members.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def settle_claims(claims: DataFrame, keys: list[str], supports: Column, contradicts: Column) -> DataFrame:
    """Claims grouped by what they are about: a link, a conflict if both sides speak, rejected if only the other does."""
    n = claims.groupBy(*keys).agg(F.count_if(supports).alias("supports"), F.count_if(contradicts).alias("contradicts"))
    outcome = F.when((F.col("supports") > 0) & (F.col("contradicts") > 0), "conflict").when(F.col("supports") > 0, "link").when(F.col("contradicts") > 0, "rejected").otherwise("silent")
    return n.withColumn("outcome", outcome)


def classify(expected: DataFrame, predicted: DataFrame, case: str, ident: str) -> DataFrame:
    """True positives, false positives and false negatives by case, over distinct identifiers of both sides."""
    sides = expected.select(case, ident, F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(predicted.select(case, ident, F.lit(0).alias("e"), F.lit(1).alias("p")))
    each = sides.groupBy(case, ident).agg(F.max("e").alias("e"), F.max("p").alias("p"))  # one shuffle instead of a full join
    return each.groupBy(case).agg(
        F.sum(F.col("e") * F.col("p")).alias("tp"),
        F.sum((1 - F.col("e")) * F.col("p")).alias("fp"),
        F.sum(F.col("e") * (1 - F.col("p"))).alias("fn"),
    )


def ratios(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1. Without predictions, precision is 1 if nothing was expected, else 0; without
    expectations, recall is 1; f1 is 0 where both ratios are 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp == 0, F.when(tp + fn == 0, 1.0).otherwise(0.0)).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))
    return counts.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    )


def nearest_ranks(df: DataFrame, by: str, value: str, shares: dict[str, float], buckets: int = 256) -> DataFrame:
    """(by, one column by name in shares): the value at rank ceil(share * n), exact, without sorting a group in one task.

    Equal values count together first. A histogram of equal-width buckets by group then finds the bucket that holds each
    rank, and only that bucket's distinct values are put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    ends = counts.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("n").alias("total"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets))).otherwise(0).cast("int")
    placed = counts.join(ends, by).withColumn("bucket", at)
    hist = placed.groupBy(by, "bucket").agg(F.sum("n").alias("m"), F.first("total").alias("total"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = hist.withColumn("before", before)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total"))).alias("rank")) for k, q in shares.items()]))
    hits = hist.select(by, "bucket", "before", "m", wanted.alias("w")).where("w.rank > before and w.rank <= before + m")
    inside = placed.select(by, "bucket", value, "n").join(hits.select(by, "bucket", "before", F.col("w.name").alias("name"), F.col("w.rank").alias("rank")), [by, "bucket"])
    upto = F.sum("n").over(Window.partitionBy(by, "bucket", "name").orderBy(value)) + F.col("before")
    picked = inside.withColumn("upto", upto).where("upto >= rank").groupBy(by).agg(*[F.min(F.when(F.col("name") == k, F.col(value))).alias(k) for k in shares])
    return picked


def distribution(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, least, median, 95th percentile (nearest rank), greatest, mean and population deviation by group."""
    base = df.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation")
    )
    return base.join(nearest_ranks(df, by, value, {"p50": 0.5, "p95": 0.95}), by)


def share_equal_first(df: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """(by, n, share): the share of rows whose value equals that of the first row of the group."""
    first = df.groupBy(by).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    return df.join(first, by).groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(value).eqNullSafe(F.col("_first")).cast("double")).alias("share"))


def latest_then_sum(df: DataFrame, unit: list[str], value: str, order: list[str], by: str) -> DataFrame:
    """The newest value of each unit, summed by group."""
    last = df.groupBy(*unit).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    return last.groupBy(by).agg(F.count("*").alias("units"), F.sum("_v").alias("total"))


def direct_counts(paths: DataFrame, path: str, prefixes: Column, child: Column) -> DataFrame:
    """(module, files, children): files directly in each directory, and how many directories lie directly in it.

    Every ancestor is a module, also one without files of its own.
    """
    rows = paths.select(F.col(path).alias("_p"), F.explode(prefixes).alias("module"))
    own = rows.groupBy("module").agg(F.count_if(F.col("module") == F.col("_p")).alias("files"))
    kids = rows.select("module", child.alias("_up")).distinct().groupBy("_up").count().select(F.col("_up").alias("module"), F.col("count").alias("children"))
    return own.join(kids, "module", "left").select("module", "files", F.coalesce("children", F.lit(0)).cast("bigint").alias("children"))


def merge_budgets(df: DataFrame, by: list[str], counters: list[str], limits: dict[str, int], parts: int) -> DataFrame:
    """Sums of counters, what the limits leave (never below 0), and an even split of it into parts (rounded down)."""
    sums = df.groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in counters])
    left = {f"{c}_left": F.greatest(F.lit(0), F.lit(limits[c]) - F.col(c)).cast("bigint") for c in counters}
    return sums.withColumns(left).withColumns({f"{c}_share": F.floor(F.col(f"{c}_left") / parts).cast("bigint") for c in counters})
