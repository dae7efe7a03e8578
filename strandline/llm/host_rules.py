"""Operator 1: quality rules with verdicts by host, in DataFrame functions only.

Four rules are judged on every text: `short` and `repeats` (the base rules), `symbols` and `dup_lines`. Failures are
summed by host, each rule's rate is shrunk towards the mean of all hosts by a beta prior fitted to the hosts'
rates (method of moments), and the verdict of a host comes back to its documents by a join:

* a host whose shrunk rate of failing documents exceeds `max_host_rate` loses all its documents;
* a host enforces `symbols` or `dup_lines` on its documents where its shrunk rate for that rule exceeds
  `enforce_rate`; on hosts with a clean record a single failure is forgiven.

Defined cases: null and empty texts have no words and fail `short`. A null host is a host of its own. Repeated rows
are judged one by one. An empty table gives an empty result. Other columns of the input are passed through as they are,
whatever their names; those named like a column of the result are replaced. A very long text is measured whole, in arrays
of its words within one task. A rate equal to a limit does not exceed it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import SEPARATORS, stash, table

RULES = ("short", "repeats", "symbols", "dup_lines")
WINDOW = 8


def own_names(docs: DataFrame) -> Callable[[str], str]:
    """Names for helper columns that no column of docs starts with."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return lambda name: mark + name


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def without(docs: DataFrame, names) -> DataFrame:
    """docs without columns of these names, in any case."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines; clashing columns are replaced.

    Windows of a text are compared by a 64-bit hash of the hashes of their eight words. Positions of repeated windows are
    sorted, and each adds the words that the one before it did not cover; n log n in the words of the text.
    """
    my = own_names(docs)
    words, lines, hashes, windows, ordered, starts = map(my, ("words", "lines", "hashes", "windows", "ordered", "starts"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.withColumn(words, F.filter(F.split(body, SEPARATORS), lambda w: w != ""))
    d = d.withColumn(lines, F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(words) - (WINDOW - 1)
    # a window's hash chains its words' hashes, so their order counts
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(WINDOW)]))
    d = d.withColumn(windows, F.when(n > 0, every).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size(windows) > F.size(F.array_distinct(windows))
    # (hash, position) in order: a window is repeated if a neighbour has its hash
    d = d.withColumn(ordered, F.when(repeated, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get(ordered, k)
    same = F.filter(ordered, lambda x, k: (F.coalesce(at(k - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(at(k + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn(starts, F.sort_array(F.transform(same, lambda x: x["i"])))
    gap = F.transform(starts, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - i, F.lit(WINDOW))))
    covered = F.aggregate(gap, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in MEASURES],
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.when(repeated, covered).otherwise(0).cast("bigint").alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
    )


def judge(measured: DataFrame) -> DataFrame:
    """Adds fails_<rule> for each rule and base_failed."""
    rule = {
        "short": F.col("n_words") < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 3 * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > 40 * F.col("n_lines"),
    }
    d = measured.withColumns({f"fails_{k}": v for k, v in rule.items()})
    return d.withColumn("base_failed", F.col("fails_short") | F.col("fails_repeats"))


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """One row by host: documents, failures and shrunk rates by rule (any: of documents that fail any rule).

    The prior of each rule is a beta distribution with the mean and the variance of the hosts' raw rates. Where the
    hosts vary no more than sampling would make them (or there is one host), the prior is as strong as one host's
    mean count. Sums are partial before the shuffle, so a hot host sends one row for each task.
    """
    fails = {k: F.col(f"fails_{k}") for k in RULES}
    fails["any"] = fails["short"] | fails["repeats"] | fails["symbols"] | fails["dup_lines"]
    by = judged.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), *[F.sum(c.cast("bigint")).alias(f"failed_{k}") for k, c in fails.items()]
    )
    stats = [F.avg("n_docs").alias("mean_n")]
    for k in fails:
        rate = (F.col(f"failed_{k}") + 0.5) / (F.col("n_docs") + 1)
        stats += [F.avg(rate).alias(f"m_{k}"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias(f"v_{k}"), F.avg(rate * (1 - rate) / F.col("n_docs")).alias(f"s_{k}")]
    prior = by.agg(*stats).first()  # one row, whatever the input
    if prior["mean_n"] is None:
        prior = {x: 0.5 for x in ["mean_n", *[f"{q}_{k}" for k in fails for q in "mvs"]]}
    d = by
    for k in fails:
        m, extra = prior[f"m_{k}"], prior[f"v_{k}"] - prior[f"s_{k}"]
        strength = max(1.0, m * (1 - m) / extra - 1) if extra > 1e-12 else max(1.0, prior["mean_n"])
        d = d.withColumn(f"rate_{k}", (F.col(f"failed_{k}") + m * strength) / (F.col("n_docs") + strength))
    return d.select("host", "n_docs", *[f"failed_{k}" for k in fails], *[f"rate_{k}" for k in fails])


def apply_host_rules(
    docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = 0.5, enforce_rate: float = 0.01, keep_text: bool = True
) -> DataFrame:
    """docs with the measures, fails_<rule>, base_failed, host_rate and kept; without the text if keep_text is false.

    Texts are measured once, into a written table that both the sums by host and the result read. The verdicts by host
    are written too, so the planner knows their size when it chooses the join: a table of hosts below Spark's broadcast
    threshold goes to the documents, and no text moves; a larger one (the hosts of the web) is joined by shuffle, where a
    hot host is a skewed key of the larger side only, which Spark splits (AQE skew join).
    """
    my = own_names(docs)
    docs = without(docs, {"host_rate", "kept", "base_failed", *[f"fails_{k}" for k in RULES]})
    measured = measure(docs, text)
    judged = stash(judge(measured if keep_text else without(measured, {text.lower()})), "host-rules")
    verdicts = host_rates(judged, host).select(
        F.col("host").alias(my("host")),
        F.col("rate_any").alias("host_rate"),
        (F.col("rate_any") > max_host_rate).alias(my("reject")),
        *[(F.col(f"rate_{k}") > enforce_rate).alias(my(k)) for k in ("symbols", "dup_lines")],
    )
    verdicts = stash(verdicts, "hosts")
    d = judged.join(verdicts, F.col(host).eqNullSafe(F.col(my("host"))), "left")
    bad = F.col("base_failed") | F.col(my("reject")) | (F.col("fails_symbols") & F.col(my("symbols"))) | (F.col("fails_dup_lines") & F.col(my("dup_lines")))
    return d.select(*[F.col(f"`{c}`") for c in judged.columns], "host_rate", (~bad).alias("kept"))


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    d = apply_host_rules(docs, keep_text=False)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))
