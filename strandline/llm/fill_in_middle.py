"""Operator 12: fill-in-the-middle transformation, in Spark SQL functions only.

A text becomes an array of units (`regexp_extract_all`): code points, words or lines. The first four groups of eight hex
digits of a SHA-256 over seed and id are four numbers (`conv`): two choose the cuts, one whether the text stays plain, one
the arrangement. `slice` and `array_join` make prefix, middle and suffix, and the output puts them between sentinels:

* psm: `<P>` prefix `<S>` suffix `<M>` middle
* spm: `<S>` suffix `<P>` prefix `<M>` middle
* plain: the text, where it is empty, holds a sentinel itself, or is drawn to stay so.

As a text that is rearranged holds no sentinel, and no sentinel's end begins another, splitting the output at its
sentinels gives the parts back (`restore`).

Defined cases: a null text is empty, and so plain; a null id hashes as an empty one. Rows are transformed one by one, so
repeated rows give equal rows, and equal cuts (ties) an empty middle. A very long text is one array of its units within
one task, some 100 bytes a unit while its row is worked on; nothing is shuffled or collected. An empty table gives an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import table

#: What a unit is. Together the units of a text are the whole text.
UNITS = {"character": r"(?s).", "word": r"\s+|\S+\s*", "line": r"[^\n]*\n|[^\n]+"}
SENTINELS = ("<P>", "<S>", "<M>")


def _checked(sentinels: tuple[str, str, str]) -> str:
    """A pattern of the sentinels, none of which may be found across the border of another one and a text."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")
    return "|".join(map(re.escape, sentinels))


def draws(ident: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = "1", unit: str = "character", plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output); n is the number of units, and a plain text has no parts."""
    p, s, m = sentinels
    _checked(sentinels)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), body.alias("text"))
    d = d.withColumn("units", F.regexp_extract_all("text", F.lit(UNITS[unit]), 0))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    n = F.size("units")
    holds = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    form = F.when((n == 0) | holds | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    a, b = h1 % (n + 1), h2 % (n + 1)
    d = d.select("doc_id", "text", "units", n.cast("bigint").alias("n"), form.alias("form"), F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"))
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    cut = F.struct(part(F.lit(1), F.col("a")).alias("prefix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), part(F.col("b") + 1, F.size("units") - F.col("b")).alias("suffix"))
    d = d.select("doc_id", "text", "n", "form", F.when(F.col("form") != "plain", cut).alias("cut"))
    psm = F.concat(F.lit(p), "cut.prefix", F.lit(s), "cut.suffix", F.lit(m), "cut.middle")
    spm = F.concat(F.lit(s), "cut.suffix", F.lit(p), "cut.prefix", F.lit(m), "cut.middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return d.select("doc_id", "n", "form", F.length("cut.prefix").cast("bigint").alias("prefix_chars"), F.length("cut.middle").cast("bigint").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, _checked(sentinels), -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, transformed and restored."""
    d = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )
