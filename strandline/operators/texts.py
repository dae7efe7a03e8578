"""Operators over text tables: search, similar names, scans, duplicate groups, passages, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions.tables import cut


def tfidf(sections: DataFrame, ident: str, heading: Column, body: Column, terms: list[str]) -> DataFrame:
    """(ident, score) of sections that hold a term: the sum over terms of tf / length * ln(1 + N / df), three times that
    for terms of the heading.

    Only the query's terms are counted, inside each section's word array, so the pass over the sections needs no explode
    and no shuffle of words; document frequencies come back as one row.
    """
    terms = sorted(set(terms))
    base = sections.select(F.col(ident), tx.words(F.concat_ws(" ", heading, body)).alias("_w"), tx.words(heading).alias("_h"))
    count = {t: F.size("_w") - F.size(F.array_remove("_w", t)) for t in terms}
    d = base.select(ident, F.greatest(F.lit(1), F.size("_w")).alias("_n"), *[c.alias(f"_c{i}") for i, c in enumerate(count.values())], *[F.array_contains("_h", t).alias(f"_b{i}") for i, t in enumerate(terms)])
    d = cut(d, "terms")  # small numbers by section, so texts are split once
    df = d.agg(F.count("*").alias("_all"), *[F.count_if(F.col(f"_c{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    hits = d.where(" or ".join(f"_c{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(df))  # one row
    score = sum(F.when(F.col(f"_c{i}") > 0, F.col(f"_c{i}") / F.col("_n") * F.log(1 + F.col("_all") / F.col(f"_d{i}")) * F.when(F.col(f"_b{i}"), 3).otherwise(1)).otherwise(0.0) for i in range(len(terms)))
    return hits.select(ident, score.alias("score"))


def similar_names(df: DataFrame, name: str, least: float) -> DataFrame:
    """(a, b, dice, a_rows, b_rows): pairs of different names whose trigram sets have a Dice coefficient of least or more.

    Equal names are one class with a number of rows. Names meet through the rarest of their trigrams only (prefix
    filter: a pair that reaches the threshold shares one of the first |x| - ceil(t / (2 - t) |x|) + 1 in order of
    rarity), so a common trigram does not pair all names; each pair is then verified.
    """
    names = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("rows")).withColumn("grams", tx.trigrams(F.col("name")))
    rare = names.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    need = least / (2 - least)
    each = names.select("name", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(rare, "gram")
    ranked = each.groupBy("name", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "gram"))), lambda x: x["gram"]).alias("order"))
    prefix = ranked.select("name", "size", F.explode(F.slice("order", F.lit(1), F.greatest(F.lit(1), F.col("size") - F.ceil(F.lit(need) * F.col("size")).cast("int") + 1))).alias("gram"))
    a, b = (prefix.select(F.col("name").alias(x), F.col("size").alias(f"{x}_size"), "gram") for x in "ab")
    longest = (2 - least) / least
    pairs = a.join(b, "gram").where("a < b").where((F.col("a_size") <= longest * F.col("b_size")) & (F.col("b_size") <= longest * F.col("a_size"))).select("a", "b").distinct()
    left, right = (names.select(F.col("name").alias(x), F.col("rows").alias(f"{x}_rows"), F.col("grams").alias(f"{x}_grams")) for x in "ab")
    d = pairs.join(left, "a").join(right, "b").withColumn("dice", tx.dice(F.col("a_grams"), F.col("b_grams")))
    return d.where(F.col("dice") >= least).select("a", "b", "dice", "a_rows", "b_rows")


def secret_hits(df: DataFrame, ident: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(ident, rule, line, fingerprint) of every match; the fingerprint is a hash of rule and match, so no secret is kept."""
    lines = df.select(ident, F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_line"))

    def matches(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("_line", F.lit(pattern), 0), lambda h: F.struct(F.lit(name).alias("rule"), F.sha2(F.concat(F.lit(f"{name}:"), h).cast("binary"), 256).alias("fingerprint")))

    hits = F.flatten(F.array(*[matches(n, p) for n, p in rules]))
    any_ = reduce(Column.__or__, [F.col("_line").rlike(p) for _, p in rules])
    d = lines.where(any_).select(ident, (F.col("_i") + 1).cast("bigint").alias("line"), F.explode(hits).alias("_h"))
    return d.select(ident, "_h.rule", "line", "_h.fingerprint")


def duplicate_members(df: DataFrame, ident: str, fingerprint: Column) -> DataFrame:
    """(ident, canonical_id, members, kept) of rows whose fingerprint occurs more than once; canonical is the smallest id.

    Groups are counted by partial aggregates and joined back; none is collected.
    """
    d = df.select(ident, fingerprint.alias("_f"))
    groups = d.groupBy("_f").agg(F.min(ident).alias("canonical_id"), F.count("*").alias("members")).where("members > 1")
    return d.join(groups, "_f").select(ident, "canonical_id", "members", (F.col(ident) == F.col("canonical_id")).alias("kept"))


def both_sides(df: DataFrame, keys: list[str], one: Column, other: Column) -> DataFrame:
    """Groups in which both conditions occur, with how often."""
    return df.groupBy(*keys).agg(F.count_if(one).alias("one"), F.count_if(other).alias("other")).where("one > 0 and other > 0")


def passages_in(documents: DataFrame, passages: DataFrame, ident: str, text: str, passage_id: str, passage: str, words: int = 6) -> DataFrame:
    """(ident, passage_id) where the passage's words stand in a row in the document.

    Documents and passages meet on the passage's first words (hashed windows of that length; shorter passages by their
    own length), never all with all, and each meeting is verified in full.
    """
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    p = passages.select(passage_id, tx.words(F.col(passage)).alias("_p")).where(F.size("_p") > 0)
    p = p.withColumn("_k", F.least(F.lit(words), F.size("_p"))).withColumn("_key", F.xxhash64(F.slice(hashed("_p"), F.lit(1), F.col("_k"))))
    d = documents.select(ident, tx.words(F.col(text)).alias("_w"))

    def starts(k: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_x") - (k - 1)), lambda i: F.xxhash64(F.slice("_x", i, F.lit(k)))))

    found = None
    for k in sorted(r["_k"] for r in p.select("_k").distinct().collect()):  # at most `words` numbers
        each = d.where(F.size("_w") >= k).select(ident, hashed("_w").alias("_x")).select(ident, F.explode(starts(k)).alias("_key"))
        hit = each.join(p.where(F.col("_k") == k).select("_key", passage_id), "_key").select(ident, passage_id)
        found = hit if found is None else found.union(hit)
    if found is None:
        return documents.select(ident).crossJoin(passages.select(passage_id)).limit(0)
    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    full = found.distinct().join(d, ident).join(p.select(passage_id, "_p"), passage_id)
    return full.where(joined(F.col("_w")).contains(joined(F.col("_p")))).select(ident, passage_id)


def rank_by_hints(candidates: DataFrame, name: str, hints: list[str], allowed: Column, visited: DataFrame, key: str) -> DataFrame:
    """Candidates not visited, scored by shared words (80 each), hints touched (120 each), permission (100) and novelty
    (80), at most 1000."""
    d = candidates.join(visited.select(key), key, "left_anti")
    tokens = tx.term_set(F.col(name))
    groups = [sorted(set(h.lower().split())) for h in hints]
    every = sorted({w for g in groups for w in g})
    shared = F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in every])))
    touched = sum(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in g])).cast("int") for g in groups)
    return d.withColumn("score", F.least(F.lit(1000), shared * 80 + touched * 120 + F.when(allowed, 100).otherwise(0) + 80).cast("bigint"))
