"""Searches, bounded paths and evidence links over tables of nodes, edges and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.tables import cut
from strandline.operators import graphs

#: Ids of one template that are compared as one, and pairs of ids that a task is given.
IDS_OF_A_BLOCK, PAIRS_OF_A_TASK = 512, 1 << 23
#: Edges and claims with their evidence that a task is given.
EDGES_OF_A_TASK, CLAIMS_OF_A_TASK = 1 << 17, 1 << 14


def search(nodes: DataFrame, text: str, kinds: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Nodes(id, kind, title) whose title holds the text in any case, of some kinds if given; the first by title and id."""
    d = nodes.where(F.contains(F.lower("title"), F.lit(text.lower())))
    return (d.where(F.col("kind").isin(kinds)) if kinds is not None else d).orderBy("title", "id").limit(limit)


def eligible(edges: DataFrame, types: list[str] | None = None, tiers: list[str] | None = None, reviews: list[str] | None = None) -> DataFrame:
    """Edges of the types, tiers and review states asked for; None asks for all."""
    for name, wanted in (("type", types), ("tier", tiers), ("review_state", reviews)):
        edges = edges.where(F.col(name).isin(wanted)) if wanted is not None else edges
    return edges


def evidence_paths(edges: DataFrame, start: DataFrame, end: DataFrame, depth: int = 12, limit: int = 200, **wanted) -> DataFrame:
    """(start, finish, nodes, edges, hops) of trails over eligible edges(edge_id, src, dst, type, tier, review_state),
    shortest first, ties by edge ids; at most limit (a report's size)."""
    d = graphs.trails(eligible(edges, **wanted).select("edge_id", "src", "dst"), start, end, depth, enough=limit)
    return d.withColumn("hops", F.size("edges")).orderBy("hops", "edges", "nodes").limit(limit)


def scoped_neighbourhood(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, kinds: list[str] | None = None, types: list[str] | None = None,
    node_limit: int | None = None, edge_limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, dist) within depth over nodes of some kinds and edges of some types, nearest first, and the edges inside."""
    e = edges.where(F.col("type").isin(types)) if types is not None else edges
    if kinds is not None:
        ok = nodes.where(F.col("kind").isin(kinds)).select("id").union(seeds.select("id")).distinct()
        for side in ("src", "dst"):
            e = e.join(ok.withColumnRenamed("id", side), side, "left_semi")
    e = cut(e, "scope")
    found, inside = graphs.neighbourhood(graphs.symmetrise(e.select("src", "dst")), seeds, depth, node_limit)
    ids = found.select("id")
    inside = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return found, inside.orderBy(*sorted(e.columns)).limit(edge_limit) if edge_limit is not None else inside


def trace(references: DataFrame, symbol, direction: str = "callers", depth: int = 6, limit: int = 100) -> DataFrame:
    """(id, dist) of callers or callees of a symbol over references(src, dst), nearest first."""
    e = references if direction == "callees" else references.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seed = references.sparkSession.createDataFrame([(0, symbol)], "seed int, id " + dict(references.dtypes)["src"])
    return graphs.distances(e, seed, depth).where("dist > 0").select("id", "dist").orderBy("dist", "id").limit(limit)


def callers_at(candidates: DataFrame, references: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots(id, ...) from which a candidate(id) is reached over references(src, dst) of any kind."""
    depends = references.select(F.col("src").alias("id"), F.col("dst").alias("on_id"))
    return roots.join(graphs.closure(depends, candidates.select("id")), "id", "left_semi")


def longest_paths(edges: DataFrame, start: DataFrame, depth: int = 9) -> DataFrame:
    """(start, hops, nodes): the longest directed path from each start without a node twice; ties go to the first by nodes.

    Of the paths that reach a node in as many steps only those over different nodes differ, so all are kept a level.
    """
    steps = cut(edges.select(F.col("src").alias("at"), "dst").distinct(), "steps")
    walk = start.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("nodes"))
    every = cut(walk, "paths")
    walk = every
    for _ in range(depth):
        walk = walk.join(steps, "at").where(~F.array_contains("nodes", F.col("dst")))
        walk = cut(walk.select("start", F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes")), "paths")
        if walk.isEmpty():
            break
        every = every.union(walk)
    best = F.min(F.struct((-F.size("nodes")).alias("n"), F.col("nodes"))).alias("b")
    return every.groupBy("start").agg(best).select("start", (-F.col("b.n") - 1).alias("hops"), F.col("b.nodes").alias("nodes"))


def latest_descendants(df: DataFrame, ident: str, parent: str, at: str) -> DataFrame:
    """(root, latest): the newest of all that descend from a row without a parent. Pointers double until all are roots."""
    known = df.select(F.col(ident).alias("_p"))
    up = F.when(F.col("_p").isNotNull(), F.col(parent)).otherwise(F.col(ident))
    d = df.join(known, F.col(parent) == F.col("_p"), "left").select(F.col(ident).alias("id"), up.alias("up"), F.col(at).alias("at"))
    d, moved = cut(d, "roots"), None
    roots = d.where("id = up").select("up")
    while moved != 0:
        j = d.select(F.col("id").alias("up"), F.col("up").alias("far"))
        d = cut(d.join(j, "up").select("id", F.col("far").alias("up"), "at", (F.col("far") != F.col("up")).alias("m")), "roots")
        left = d.where("m").count()
        d = d.drop("m")
        if left == moved:  # in a tree fewer rows move each time; what still moves goes in circles and has no root
            break
        moved = left
    return d.join(roots, "up", "left_semi").groupBy(F.col("up").alias("root")).agg(F.max_by("id", F.struct("at", "id")).alias("latest"))


def capped_pairs(sources: DataFrame, targets: DataFrame, by: str, source: str, target: str, cap: int) -> DataFrame:
    """(by, source, target): the first cap pairs of each group in order of (source, target). Sources and targets that no
    such pair can hold are left out by their place first, so the product is never formed."""
    w = lambda c: Window.partitionBy(by).orderBy(c)
    t = targets.select(by, target).distinct().withColumn("_t", F.row_number().over(w(target)))
    n = t.groupBy(by).agg(F.count("*").alias("_n"))
    s = sources.select(by, source).distinct().withColumn("_s", F.row_number().over(w(source)))
    s = s.join(n, by).where((F.col("_s") - 1) * F.col("_n") < cap)
    return s.join(t.where(F.col("_t") <= cap), by).where((F.col("_s") - 1) * F.col("_n") + F.col("_t") <= cap).select(by, source, target)


def confident(tier: Column, review: Column, stale: Column) -> Column:
    """Whether a link counts: no stale evidence, tier C accepted, tiers A and B accepted or without need of review."""
    return ~stale & (tier != "D") & F.when(tier == "C", review == "accepted").otherwise(review.isin("accepted", "not_required"))


def override(current: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Rows by key: those of pending in place of those of current."""
    return pending.unionByName(current.join(pending.select(key), key, "left_anti"))


def compatibility(d: DataFrame, application: str, statuses: list[str], methods: DataFrame, runs: DataFrame, commits: DataFrame) -> DataFrame:
    """Adds code: the first reason why evidence(application_id, status, method, source_kind, run_id, commit_sha) does not count.

    methods has (method, source_kind), runs (run_id), commits (commit_sha): what is compatible."""
    m = methods.select("method", "source_kind").distinct().withColumn("_m", F.lit(True))
    r, c = runs.select("run_id").distinct().withColumn("_r", F.lit(True)), commits.select("commit_sha").distinct().withColumn("_c", F.lit(True))
    x = d.join(m, ["method", "source_kind"], "left").join(r, "run_id", "left").join(c, "commit_sha", "left")
    code = (
        F.when(F.col("application_id") != application, "application_mismatch").when(~F.col("status").isin(statuses), "invalid_evidence_status")
        .when(F.col("_m").isNull(), "unsupported_source").when(F.col("_r").isNull(), "incompatible_run")
        .when(F.col("commit_sha").isNotNull() & F.col("_c").isNull(), "incompatible_commit")
    )
    return x.withColumn("code", code).select(*d.columns, "code")


def links_of_claims(claims: DataFrame) -> DataFrame:
    """One link by (from_id, relationship, to_id) of claims with assertion, tier and evidence_ids: the best tier, all
    methods and evidence of both sides in order, and whether the sides contradict each other."""
    side = lambda s: F.count_if(F.col("assertion") == s)
    ids = claims.select("from_id", "relationship", "to_id", "assertion", "tier", "method", F.explode_outer("evidence_ids").alias("e"))
    g = ids.groupBy("from_id", "relationship", "to_id").agg(
        F.min("tier").alias("tier"), F.array_sort(F.collect_set("method")).alias("methods"), F.array_sort(F.collect_set("e")).alias("evidence_ids"),
        (side("supports") > 0).alias("_s"), (side("contradicts") > 0).alias("_c"),
    )
    return g.select("from_id", "relationship", "to_id", "tier", "methods", "evidence_ids", (F.col("_s") & F.col("_c")).alias("conflict"))


def backed_edges(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges(id, evidence_ids) whose evidence all stands in one claim(claim_id, evidence_ids): (id, claim_id).

    An edge is looked for at its rarest evidence only, and 256 bits of what each side holds leave out nearly all claims
    that lack some other; those that stay are compared as a whole.
    """
    at = F.xxhash64("_e")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(at, 2), F.lit(64)).cast("int"))
    bits = lambda side: [F.bit_or(F.when(F.pmod(at, F.lit(4)) == i, one).otherwise(F.lit(0).cast("bigint"))).alias(f"_{side}{i}") for i in range(4)]
    e = cut(edges.select("id", F.array_distinct("evidence_ids").alias("ids")).where(F.size("ids") > 0), "edges")
    c = cut(claims.select("claim_id", F.array_distinct("evidence_ids").alias("ids")), "claims")
    e, c = e.repartition(e.count() // EDGES_OF_A_TASK + 1, "id"), c.repartition(c.count() // CLAIMS_OF_A_TASK + 1, "claim_id")
    each = c.select("claim_id", F.explode("ids").alias("_e"))
    n = each.groupBy("_e").agg(F.count("*").alias("_n"))
    rare = e.select("id", F.explode("ids").alias("_e")).join(n, "_e", "left").groupBy("id").agg(F.min(F.struct("_n", "_e")).alias("_r"), F.bool_and(F.col("_n").isNotNull()).alias("_all"), *bits("a"))
    asked = e.join(rare.where("_all").drop("_all").withColumn("_e", F.col("_r._e")).drop("_r"), "id")
    held = each.join(each.groupBy("claim_id").agg(*bits("b")), "claim_id")
    may = asked.join(held, "_e")
    for i in range(4):
        may = may.where(F.col(f"_a{i}").bitwiseAND(F.col(f"_b{i}")) == F.col(f"_a{i}"))
    whole = may.select("id", "ids", "claim_id").join(c.withColumnRenamed("ids", "_held"), "claim_id")
    return whole.where(F.size(F.array_except("ids", "_held")) == 0).select("id", "claim_id")


def induced(parts: DataFrame, links: DataFrame, scope: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The parts of the keys in scope, and the links(from_key, to_key) with both ends in scope."""
    ids = scope.select(key).distinct()
    inside = links
    for side in ("from_key", "to_key"):
        inside = inside.join(ids.withColumnRenamed(key, side), side, "left_semi")
    return parts.join(ids, key, "left_semi"), inside


def template_overlap(templates: DataFrame) -> DataFrame:
    """(a, b, kind) of pairs of endpoint templates(id, method, path): exact, candidate (some path fits both) or not listed.

    A segment {param} fits any; templates meet by method, number of segments and first segment, where a parameter meets
    all, so literal templates of different starts are never compared. Each distinct (method, path) is compared once; its ids
    stand in blocks, and pairs of blocks are dealt to as many tasks as their pairs of ids need, so no common template is one task.
    """
    is_param = lambda s: s.rlike(r"^\{[^{}]+\}$")
    t = templates.where("id is not null and method is not null and path is not null").select("id", "method", "path")
    n = t.groupBy("method", "path").agg(F.ceil(F.count("*") / IDS_OF_A_BLOCK).alias("_n"))
    t = t.join(n, ["method", "path"]).withColumn("block", F.pmod(F.xxhash64("id"), "_n"))
    blocks = cut(t.groupBy("method", "path", "block").agg(F.collect_list("id").alias("ids")), "blocks")
    c = blocks.select("method", "path").distinct().withColumn("s", F.filter(F.split("path", "/"), lambda s: s != ""))
    c = c.withColumn("n", F.size("s")).withColumn("first", F.coalesce(F.get("s", F.lit(0)), F.lit("")))
    a = c.select(*[F.col(x).alias(f"a_{x}") for x in ("path", "s", "first")], "method", "n")
    b = c.select(*[F.col(x).alias(f"b_{x}") for x in ("path", "s", "first")], "method", "n")
    open_ = lambda d, c: d.where(is_param(F.col(c)))
    literal = lambda d, c: d.where(~is_param(F.col(c)))
    met = literal(a, "a_first").join(literal(b, "b_first").withColumn("a_first", F.col("b_first")), ["method", "n", "a_first"])
    cols = ["method", "a_path", "a_s", "b_path", "b_s"]
    every = met.select(*cols).union(open_(a, "a_first").join(b, ["method", "n"]).select(*cols)).union(literal(a, "a_first").join(open_(b, "b_first"), ["method", "n"]).select(*cols))
    fits = F.forall(F.zip_with("a_s", "b_s", lambda x, y: is_param(x) | is_param(y) | (x == y)), lambda v: v)
    every = every.where("a_path <= b_path").where(fits).select("method", "a_path", "b_path")
    side = lambda p: blocks.select("method", F.col("path").alias(f"{p}_path"), F.col("block").alias(f"{p}_block"), F.col("ids").alias(f"{p}_ids"))
    met = every.join(side("a"), ["method", "a_path"]).join(side("b"), ["method", "b_path"])
    same = F.col("a_path") == F.col("b_path")
    met = cut(met.where(~same | (F.col("a_block") <= F.col("b_block"))).select("a_ids", "b_ids", same.alias("exact"), (same & (F.col("a_block") == F.col("b_block"))).alias("own")), "block-pairs")
    n = met.agg(F.sum(F.size("a_ids").cast("bigint") * F.size("b_ids"))).first()[0] or 0
    p = met.repartition(int(n // PAIRS_OF_A_TASK) + 1).select("exact", "own", "b_ids", F.explode("a_ids").alias("x")).select("exact", "own", "x", F.explode("b_ids").alias("y"))
    p = p.where(F.when(F.col("own"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("exact"), "exact").otherwise("candidate").alias("kind"))


def first_owners(pages: DataFrame, ident: str, keys: list[str]) -> DataFrame:
    """Pages accepted in order of ident: one is dropped if an accepted page before it has the same value of any key. A null key
    is nobody's; rows of one ident are one page.

    In each round the pages that come first in all their groups are accepted and all others of those groups dropped, so
    the result is that of a loop over the pages, in as many rounds as the longest chain of such decisions.
    """
    left, done = cut(pages.select(ident, *keys).dropDuplicates([ident]), "pages"), None
    while not left.isEmpty():
        first = left
        for k in keys:
            low = left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(ident).alias("_low"))
            first = first.join(low, k, "left").where(F.col(k).isNull() | (F.col(ident) == F.col("_low"))).drop("_low")
        first = cut(first.select(ident, *keys), "owners")
        done = first if done is None else done.union(first)
        left = left.join(first.select(ident), ident, "left_anti")
        for k in keys:
            left = left.join(first.select(k), k, "left_anti")
        left = cut(left.select(ident, *keys), "pages")
    return left if done is None else done
