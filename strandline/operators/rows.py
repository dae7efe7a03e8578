"""Row selection and joins: paging, first-match ladders, quantifiers, integrity, latest rows, intervals, templates, diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task of an integrity check is given.
ROWS_OF_A_TASK = 1 << 19


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The rows after a cursor, in key order, at most limit; one more row, marked is_next, if there is a further page."""
    if after is not None:
        kinds = dict(df.dtypes)
        df = df.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, after)]))
    page = df.orderBy(*keys).limit(limit + 1)  # a top-k: no full sort
    return page.withColumn("is_next", F.row_number().over(Window.orderBy(*keys)) > limit)


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null condition does not hold."""
    out = None
    for cond, name in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)


def labels(rules: list[tuple[Column, str]]) -> Column:
    """The sorted names of all rules that hold, joined by commas."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))), ",")


def violations(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(code, id) of the rows that each check finds; a publication is valid if there are none."""
    found = [df.select(F.lit(code).alias("code"), F.col(df.columns[0]).cast("string").alias("id")) for code, df in checks]
    return reduce(DataFrame.unionByName, found)


def tasks_for(*sides: DataFrame) -> int:
    """Tasks to deal the rows of sides to; counting tables that are files reads no column."""
    return sum(d.count() for d in sides) // ROWS_OF_A_TASK + 1


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have. Rows are dealt by number before they are grouped: keys seldom repeat, so partial counts would only hold
    them all twice; a key that does is counted in its task without its rows being held."""
    return df.select(*keys).repartition(tasks_for(df), *keys).groupBy(*keys).count().where("count > 1").select(*keys)


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys of df that no parent has; a null key is no orphan. A task holds its share of the parents, dealt by number, and reads past them."""
    tasks = tasks_for(df, parent)
    known = parent.select(F.col(parent_key).alias("_k")).repartition(tasks, "_k").hint("shuffle_hash")
    return df.where(F.col(key).isNotNull()).select(key).repartition(tasks, key).join(known, F.col(key) == F.col("_k"), "left_anti")


def latest(df: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of the largest order key by group, as one aggregate: no sort, and partial results before the shuffle."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in keep])


def as_of(points: DataFrame, history: DataFrame, key: str, at: str, since: str, keep: list[str], tie: str) -> DataFrame:
    """Each point with the newest row of history of its key not after it (nulls if none): one window over both sides.

    A union and a window keep the work n log n by key, where a join on key and <= would pair every point with its past.
    """
    cols = [key, "_t", "_p", "_v", "_tie", "_id"]
    h = history.select(F.col(key), F.col(since).alias("_t"), F.lit(0).alias("_p"), F.struct(*keep).alias("_v"), F.col(tie).alias("_tie"), F.lit(None).cast("struct<x:string>").alias("_id"))
    rest = [c for c in points.columns if c != key]
    p = points.select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_p"), F.lit(None).cast(h.schema["_v"].dataType).alias("_v"), F.lit(None).cast(h.schema["_tie"].dataType).alias("_tie"), F.struct(*rest).alias("_id"))
    h = h.withColumn("_id", F.lit(None).cast(p.schema["_id"].dataType))
    w = Window.partitionBy(key).orderBy("_t", "_p", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    d = h.select(cols).unionByName(p.select(cols)).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return d.where("_p = 1").select(key, *[F.col(f"_id.{c}").alias(c) for c in rest], *[F.col(f"_last.{c}").alias(f"last_{c}") for c in keep])


def innermost(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, name: str, point_id: list[str], span: int) -> DataFrame:
    """Each point with the smallest interval of its group that holds it (both ends count).

    Outcome is matched, ambiguous (several of the smallest size; no name is given) or unmatched. Intervals are
    spread over cells of span units, so the join is an equi-join on (group, cell) and a long interval costs its cells.
    """
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / span), F.floor(F.col(end) / span))))
    p = points.withColumn("_cell", F.floor(F.col(at) / span))
    i = cells.select(*[F.col(c).alias(f"_{c}") for c in by], "_cell", F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(name).alias("_n"))
    hit = p.join(i, [*[p[c] == i[f"_{c}"] for c in by], p["_cell"] == i["_cell"]]).where(f"{at} between _s and _e")
    best = hit.groupBy(*point_id).agg(F.min(F.struct((F.col("_e") - F.col("_s")).alias("size"), F.col("_n").alias("name"))).alias("_lo"), F.min_by(F.col("_n"), F.struct(F.col("_e") - F.col("_s"), F.col("_n"))).alias("_first"))
    sizes = hit.groupBy(*point_id, (F.col("_e") - F.col("_s")).alias("_size")).agg(F.count_distinct("_n").alias("n"))
    best = best.join(sizes, point_id).where("_lo.size = _size").select(*point_id, "_first", "n")
    d = points.select(*point_id).distinct().join(best, point_id, "left")
    outcome = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return d.select(*point_id, outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("_first")).alias("name"))


def overlaps(df: DataFrame, by: str, start: str, end: str, ident: str, span: int) -> DataFrame:
    """Pairs of different intervals of a group that share a point, smaller id first; joined by cells of span units."""
    c = df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / span), F.floor(F.col(end) / span))))
    a = c.select(F.col(by), "_cell", F.col(ident).alias("a_id"), F.col(start).alias("a_s"), F.col(end).alias("a_e"))
    b = c.select(F.col(by), "_cell", F.col(ident).alias("b_id"), F.col(start).alias("b_s"), F.col(end).alias("b_e"))
    pairs = a.join(b, [by, "_cell"]).where("a_id < b_id and a_s <= b_e and b_s <= a_e")
    # a pair counts in the first cell that both reach, so it comes once
    return pairs.where(F.col("_cell") == F.floor(F.greatest("a_s", "b_s") / span)).select(by, "a_id", "b_id")


def ancestors(path: Column) -> Column:
    """All proper prefixes of a /-separated path, the path itself included."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def match_templates(requests: DataFrame, templates: DataFrame, path: str, method: str, ident: str) -> DataFrame:
    """Each request with the most specific template of its number of segments (parameters in braces match one segment).

    Outcome: exact (one best template, its method fits), conflict (it has another method), candidate (several of the
    best specificity), unmatched. Specificity is the number of literal segments.
    """
    segments = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    r = requests.withColumn("_seg", segments(F.col(path)))
    t = templates.select(F.col("template"), F.col("method").alias("_tm"), segments(F.col("template")).alias("_t"))
    fixed = F.size(F.filter("_t", lambda x: ~x.startswith("{")))
    t = t.withColumn("_n", F.size("_t")).withColumn("_fixed", fixed)
    ok = F.forall(F.arrays_zip("_seg", "_t"), lambda z: z["_t"].startswith("{") | (z["_seg"] == z["_t"]))
    # templates are a rule table: they go to the requests, keyed by their number of segments
    hit = r.join(t, F.size("_seg") == F.col("_n")).where(ok)
    best = hit.groupBy(ident).agg(F.max("_fixed").alias("_best"))
    top = hit.join(best, ident).where("_fixed = _best")
    by = top.groupBy(ident).agg(F.count_distinct("template").alias("n"), F.min("template").alias("template"), F.max((F.col("_tm") == F.col(method)).cast("int")).alias("fits"))
    d = requests.select(ident).join(by, ident, "left")
    outcome = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "candidate").when(F.col("fits") == 0, "conflict").otherwise("exact")
    return d.select(ident, outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("template")).alias("template"))


def structural_diff(base: DataFrame, head: DataFrame, key: str, content: str, ident: str) -> DataFrame:
    """(base_id, head_id, change): rows with a key unique on both sides are unchanged or modified; of the rest, those
    whose content is unique on both sides moved; what remains is deleted or added. Null keys and contents match nothing.

    Both sides are aggregated as one table, so a pair comes out of its own group without a join, and a key that many rows
    share is one partial sum a task.
    """
    side = lambda df, s: df.select(F.col(ident).alias("_id"), F.col(key).alias("_key"), F.col(content).alias("_content"), F.lit(s).alias("_head"))
    both = side(base, False).unionByName(side(head, True))

    def pairs(df: DataFrame, by: str) -> DataFrame:
        old, new = ~F.col("_head"), F.col("_head")
        g = df.where(F.col(by).isNotNull()).groupBy(by).agg(
            F.count_if(old).alias("_b"), F.count_if(new).alias("_h"), F.max(F.when(old, F.col("_id"))).alias("base_id"), F.max(F.when(new, F.col("_id"))).alias("head_id"),
            F.max(F.when(old, F.struct("_content"))).eqNullSafe(F.max(F.when(new, F.struct("_content")))).alias("_equal"),
        )
        return g.where("_b = 1 and _h = 1")

    same = pairs(both, "_key")
    rest = both.join(same.select("_key"), "_key", "left_anti")
    moved = pairs(rest, "_content")
    left = rest.join(moved.select("_content"), "_content", "left_anti")
    out = same.select("base_id", "head_id", F.when(F.col("_equal"), "unchanged").otherwise("modified").alias("change"))
    out = out.union(moved.select("base_id", "head_id", F.lit("moved")))
    return out.union(left.select(F.when(~F.col("_head"), F.col("_id")), F.when(F.col("_head"), F.col("_id")), F.when(F.col("_head"), "added").otherwise("deleted")))


def sync_labels(existing: DataFrame, desired: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, action) that makes existing equal to desired: insert, update, delete or keep."""
    e = existing.select(F.col(key).alias("_ek"), F.struct(*values).alias("_e"))
    d = desired.select(F.col(key).alias("_dk"), F.struct(*values).alias("_d"))
    action = F.when(F.col("_ek").isNull(), "insert").when(F.col("_dk").isNull(), "delete").when(F.col("_e").eqNullSafe(F.col("_d")), "keep").otherwise("update")
    return e.join(d, F.col("_ek") == F.col("_dk"), "full").select(F.coalesce("_ek", "_dk").alias(key), action.alias("action"))


def copy_on_write(previous: DataFrame, affected: DataFrame, staged: DataFrame, key: str, revision: int) -> DataFrame:
    """The next revision: previous rows that are neither affected nor staged anew, and all staged rows."""
    kept = previous.join(affected.select(key), key, "left_anti").join(staged.select(key), key, "left_anti")
    return kept.withColumn("origin", F.lit("copied")).unionByName(staged.withColumn("origin", F.lit("staged"))).withColumn("graph_revision", F.lit(revision).cast("bigint"))
