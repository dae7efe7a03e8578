"""Keyed state and name resolution: upserts, frontiers, fallbacks, trees of routes and classes, containment, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.tables import cut
from strandline.operators.events import positions
from strandline.operators.rows import ancestors


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """One row by key, of the highest version; where versions tie, the incoming row. One aggregate, no sort."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = both.groupBy(*key).agg(F.max_by(F.struct(*existing.columns), F.struct(*version, "_new")).alias("_r"))
    return best.select("_r.*")


def insert_missing(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The incoming rows whose key is new, the first of each key."""
    first = incoming.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min_by(F.struct(*incoming.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return first.join(existing.select(*key), key, "left_anti")


def replace_if_revision(existing: DataFrame, changes: DataFrame, key: str, revision: str, ident: list[str]) -> DataFrame:
    """(ident, outcome): replaced where the change expects the row's revision, else conflict, or missing."""
    e = existing.select(F.col(key).alias("_k"), F.col(revision).alias("_have"))
    d = changes.join(e, F.col(key) == F.col("_k"), "left")
    return d.select(*ident, F.when(F.col("_k").isNull(), "missing").when(F.col("_have") == F.col(revision), "replaced").otherwise("conflict").alias("outcome"))


def apply_deltas(counts: DataFrame, deltas: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, rejected): reference counts after summed changes; a sum that would go below zero is rejected whole."""
    d = deltas.groupBy(key).agg(F.sum("delta").alias("_d"))
    after = F.col(value) + F.coalesce("_d", F.lit(0))
    return counts.join(d, key, "left").select(key, F.when(after >= 0, after).otherwise(F.col(value)).cast("bigint").alias(value), (after < 0).alias("rejected"))


def merge_frontier(before: DataFrame, found: DataFrame, key: str, limit: int) -> DataFrame:
    """Known entries keep their status and first sighting, new ones are added as pending; the newest limit entries stay."""
    f = found.groupBy(key).agg(F.min("seen").alias("_seen"), F.max("priority").alias("_priority"))
    d = before.join(f, key, "full").select(key, F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("seen", "_seen").alias("seen"), F.coalesce("_priority", "priority").alias("priority"))
    return d.orderBy(F.desc("seen"), key).limit(limit)


def seed_pages(roots: DataFrame, sitemap: DataFrame, blocked: DataFrame, limit: int) -> DataFrame:
    """The first limit addresses, in order, of roots and sitemap that are not blocked; blocked has prefixes (prefix)."""
    u = roots.select("url").union(sitemap.select("url")).distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.length("url")), lambda i: F.left(F.col("url"), i))
    ends = F.filter(cuts, lambda p: p.endswith("/") | (p == F.col("url")))
    bad = u.select("url", F.explode(ends).alias("prefix")).join(blocked.select("prefix"), "prefix", "left_semi").select("url").distinct()
    return u.join(bad, "url", "left_anti").orderBy("url").limit(limit)


def within_budget(df: DataFrame, by: list[str], order: list[str], size: Column, limit: int) -> DataFrame:
    """The rows, in order, before the running size first exceeds the limit."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= limit)


def resolve_by_fallback(refs: DataFrame, names: DataFrame, ident: str, tries: list[Column]) -> DataFrame:
    """(ident, rank, target): the first of several names that exists, ignoring case; names has (name, target), and of equal
    names the largest target counts. rank is null where none exists."""
    n = names.groupBy(F.lower("name").alias("_n")).agg(F.max("target").alias("target"))
    each = refs.select(ident, F.posexplode(F.array(*[F.lower(t) for t in tries])).alias("rank", "_n"))
    hit = each.join(n, "_n").groupBy(ident).agg(F.min(F.struct("rank", "target")).alias("_b"))
    return refs.select(ident).join(hit, ident, "left").select(ident, "_b.rank", "_b.target")


def inherits(classes: DataFrame, base: str) -> DataFrame:
    """(name) of classes(name, parent) that extend the base, directly or not; cycles end by themselves."""
    reached = cut(classes.where(F.lower("parent") == base.lower()).select("name").distinct(), "inherits")
    frontier = reached
    while True:
        new = classes.join(frontier.select(F.lower("name").alias("_p")), F.lower("parent") == F.col("_p"), "left_semi").select("name").distinct()
        frontier = cut(new.join(reached, "name", "left_anti"), "inherits")
        if frontier.isEmpty():
            return reached
        reached = reached.union(frontier)


def route_tree(routes: DataFrame) -> DataFrame:
    """(id, pattern, layouts) of routes(id, parent, segment, layout): segments joined from the root, and the layouts of all
    ancestors in order. A level is a join; a route whose parent is missing, or in a cycle, has no root and is left out."""
    level = routes.where("parent is null").select("id", F.concat(F.lit("/"), F.coalesce("segment", F.lit(""))).alias("pattern"), F.array_compact(F.array("layout")).alias("layouts"))
    every, steps = [cut(level, "routes")], routes.where("parent is not null").select(F.col("id").alias("_id"), F.col("parent").alias("id"), "segment", "layout")
    while True:  # ids are unique, so every level holds new ones and the tree ends
        up = every[-1]
        joined = F.concat(F.regexp_replace("pattern", "/$", ""), F.lit("/"), F.coalesce("segment", F.lit("")))
        nxt = cut(up.join(steps, "id").select(F.col("_id").alias("id"), joined.alias("pattern"), F.concat("layouts", F.array_compact(F.array("layout"))).alias("layouts")), "routes")
        if nxt.isEmpty():
            break
        every.append(nxt)
    out = every[0]
    for d in every[1:]:
        out = out.union(d)
    return out


def match_routes(requests: DataFrame, routes: DataFrame, path: str, ident: str) -> DataFrame:
    """(ident, pattern) of the best routes: an equal path if there is one, else the highest specificity, ties all kept.

    Dynamic segments ({x}, :x, [x]) match one segment, * and [...x] the rest. A literal segment counts 100, a dynamic one
    1, a catch-all -100. Routes are a rule table; they meet requests by the prefix of literal segments before their first
    dynamic one, so a request is compared only with routes that start like it.
    """
    seg = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    rest = lambda s: (s == "*") | s.startswith("[...")
    dyn = lambda s: s.rlike(r"^(\{[^}]+\}|:.+|\[[^\]]+\])$")
    p = routes.select("pattern", seg(F.col("pattern")).alias("_p"))
    first = F.array_position(F.transform("_p", lambda s: rest(s) | dyn(s)), True).cast("int")
    p = p.withColumn("_head", F.array_join(F.when(first > 0, F.slice("_p", F.lit(1), first - 1)).otherwise(F.col("_p")), "/"))
    p = p.withColumn("_score", F.aggregate("_p", F.lit(0), lambda a, s: a + F.when(rest(s), -100).when(dyn(s), 1).otherwise(100)))
    p = p.withColumn("_open", F.array_position(F.transform("_p", rest), True).cast("int"))
    r = requests.select(ident, F.col(path).alias("_path"), seg(F.col(path)).alias("_r"))
    r = r.withColumn("_head", F.explode(F.concat(F.array(F.lit("")), F.when(F.size("_r") > 0, ancestors(F.col("_path"))).otherwise(F.array().cast("array<string>")))))
    fits = F.when(F.col("_open") > 0, F.size("_r") >= F.col("_open") - 1).otherwise(F.size("_r") == F.size("_p"))
    ok = F.forall(F.transform("_p", lambda s, i: rest(s) | (F.get("_r", i).isNotNull() & (dyn(s) | (s == F.get("_r", i))))), lambda x: F.coalesce(x, F.lit(False)))
    hit = r.join(p, "_head").where(fits & ok).withColumn("_rank", F.when(F.array_join("_p", "/") == F.array_join("_r", "/"), 1 << 20).otherwise(F.col("_score")))
    best = hit.groupBy(ident).agg(F.max("_rank").alias("_best"))
    return hit.join(best, ident).where("_rank = _best").select(ident, "pattern").distinct()


def nearest_ancestor(paths: DataFrame, owners: DataFrame, path: str) -> DataFrame:
    """(path, owner): the deepest directory of owners(directory, owner) that holds the path."""
    up = paths.select(path, F.posexplode(ancestors(F.col(path))).alias("_depth", "directory"))
    best = up.join(owners, "directory").groupBy(path).agg(F.max_by("owner", F.struct("_depth", "owner")).alias("owner"))
    return paths.select(path).join(best, path, "left")


def containers(df: DataFrame, by: str, start: str, end: str, ident: str, span: int) -> DataFrame:
    """(ident, outer, level) for every range that holds another of its group, the smallest first (level 1).

    The inner range is looked up by the cell of its start, which every range that holds it reaches too.
    """
    inner = df.select(by, F.floor(F.col(start) / span).alias("_cell"), F.col(ident), F.col(start).alias("_s"), F.col(end).alias("_e"))
    outer = df.select(F.col(by), F.explode(F.sequence(F.floor(F.col(start) / span), F.floor(F.col(end) / span))).alias("_cell"), F.col(ident).alias("outer"), F.col(start).alias("_os"), F.col(end).alias("_oe"))
    hit = inner.join(outer, [by, "_cell"]).where(f"_os <= _s and _oe >= _e and outer <> {ident}")
    w = Window.partitionBy(ident).orderBy(F.col("_oe") - F.col("_os"), "outer")
    return hit.select(ident, "outer", F.row_number().over(w).alias("level"))


def compare_runs(plan: DataFrame, baseline: DataFrame, head: DataFrame, by: str, check: str, value: str) -> DataFrame:
    """(by, status, changed): changed where any planned check differs or is missing on a side, preserved, or
    not_available without a baseline."""
    side = lambda df, s: df.select(by, check, F.struct(F.col(value)).alias(s))
    d = plan.select(by, check).join(side(baseline, "_b"), [by, check], "left").join(side(head, "_h"), [by, check], "left")
    d = d.join(baseline.select(by).distinct().withColumn("_any", F.lit(True)), by, "left")
    differs = F.col("_b").isNull() | F.col("_h").isNull() | ~F.col("_b").eqNullSafe(F.col("_h"))
    g = d.groupBy(by).agg(F.count_if(differs).alias("changed"), F.bool_or(F.coalesce("_any", F.lit(False))).alias("_any"))
    return g.select(by, F.when(~F.col("_any"), "not_available").when(F.col("changed") > 0, "changed").otherwise("preserved").alias("status"), F.when(F.col("_any"), F.col("changed")).otherwise(0).cast("bigint").alias("changed"))


def fixed_batches(df: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Adds batch: rows of a group in order, size to a batch. Numbers come from range blocks, so a large group is no task."""
    return positions(df, [by], order).withColumn("batch", F.floor((F.col("_pos") - 1) / size).cast("bigint")).drop("_pos")


def claimable(runs: DataFrame, at: Column, by: str, order: list[str]) -> DataFrame:
    """The oldest run of each group that is free at a time: pending, or running with an expired lease."""
    free = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_until") < at))
    return runs.where(free).groupBy(by).agg(F.min_by(F.struct(*runs.columns), F.struct(*order)).alias("_r")).select("_r.*")


def clamped_depth(df: DataFrame, by: str, order: list[str], step: Column) -> DataFrame:
    """(by, depth, branches): a depth that steps move up or down and never below zero, and how often it went down.

    A floor makes it a fold; it equals the running sum less its least value so far (or zero), so windows express it.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_s", step).withColumn("_sum", F.sum("_s").over(w))
    d = d.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(w)))
    return d.groupBy(by).agg(F.max_by(F.col("_sum") - F.col("_low"), F.struct(*order)).cast("bigint").alias("depth"), F.count_if(F.col("_s") < 0).alias("branches"))
