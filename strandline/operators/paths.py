"""Regular path search: paths whose relationships, kinds and directions follow an automaton, and impact candidates made of them.

A step (state, type, from_kind, to_kind, direction, next_state) lets a path in a state go over an edge of the type between nodes of
the kinds, along it (forward), against it (reverse) or either way (any). The search runs over the product of graph and
automaton, whose nodes are pairs (id, state), level by level from all seeds at once. The arcs that seeds come near are written first,
then distances back from the nearest target, once for all seeds, so a search enters no node from which no target is within reach. A
level holds only arcs to pairs not reached before by their seed, and paths are put together from these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.tables import cut
from strandline.operators import graphs

STEP = "state string, type string, from_kind string, to_kind string, direction string, next_state string"
#: The state of automata that have but one.
ANY = "*"


def one_state(steps: tuple) -> list[tuple]:
    """Steps (type, from_kind, to_kind, direction) that may follow one another in any order."""
    return [(ANY, *s, ANY) for s in steps]


def arcs(nodes: DataFrame, edges: DataFrame, steps: list[tuple], first: DataFrame, depth: int) -> DataFrame:
    """(src, dst, edge_id) of the product of the graph of nodes(id, kind) and edges(edge_id, src, dst, type) with the steps, as far as
    depth steps from first(id, state) enter it; src and dst are structs (id, state). Edges without both ends are in no path.

    A level reads the edges of the types that its states may take and joins them with its frontier, so what no seed comes near is never written.
    """
    flat = {(s, t, a, b, w, n) for s, t, a, b, way, n in steps for w in (("forward", "reverse") if way == "any" else (way,))}
    e = edges.select("edge_id", "src", "dst", "type")
    kinds = nodes.select("id", "kind").distinct()
    states = {s for (s,) in first.select("state").distinct().collect()}  # states of the automaton, a handful
    frontier = cut(first.distinct().join(kinds, "id").select("id", "state", "kind"), "product")
    seen, every = frontier, []
    for _ in range(depth):
        usable = sorted(x for x in flat if x[0] in states)
        if not usable or frontier.isEmpty():
            break
        walked = []
        for way, a, b in (("forward", "src", "dst"), ("reverse", "dst", "src")):
            types = sorted({x[1] for x in usable if x[4] == way})
            if types:
                walked.append(e.where(F.col("type").isin(types)).select("edge_id", "type", F.col(a).alias("a"), F.col(b).alias("b"), F.lit(way).alias("direction")))
        table = nodes.sparkSession.createDataFrame(usable, STEP)
        met = reduce(DataFrame.union, walked).join(frontier.select(F.col("id").alias("a"), "state", F.col("kind").alias("from_kind")), "a")
        met = met.join(table, ["state", "type", "from_kind", "direction"])
        ends = kinds.where(F.col("kind").isin(sorted({x[3] for x in usable}))).select(F.col("id").alias("b"), F.col("kind").alias("to_kind"))
        met = met.join(ends, ["b", "to_kind"])
        met = met.select(F.struct(F.col("a").alias("id"), F.col("state")).alias("src"), F.struct(F.col("b").alias("id"), F.col("next_state").alias("state")).alias("dst"), "edge_id", "to_kind").distinct()
        met = cut(met, "arcs")
        every.append(met.drop("to_kind"))
        new = met.select("dst.id", "dst.state", F.col("to_kind").alias("kind")).distinct()
        frontier = cut(new.join(seen, ["id", "state", "kind"], "left_anti"), "product")
        seen = seen.union(frontier)
        states = {x[5] for x in usable}
    if not every:
        end = F.struct(F.col("id"), F.col("state"))
        return frontier.join(e.limit(0), F.col("id") == F.col("src")).select(end.alias("src"), end.alias("dst"), "edge_id").limit(0)
    return reduce(DataFrame.union, every)


def search(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, steps: list[tuple], target_kinds: tuple, depth: int, start: str = ANY, accept: tuple = (ANY,), limit: int | None = None
) -> DataFrame:
    """(seed, target, target_kind, hops, nodes, edges): all shortest paths of 1 to depth steps from seeds(id) to nodes of the target kinds
    in an accepting state, each by its node ids and edge ids. Edges that run side by side make paths of their own.

    Filter edges by tier, review or revision before calling. A shortest path of the product may pass a node twice in different
    states; it is left out. limit keeps the first paths by target kind, target, hops, nodes and edges (a report's size).
    """
    first = seeds.select("id", F.lit(start).alias("state")).distinct()
    both = arcs(nodes, edges, steps, first, depth)
    states = nodes.sparkSession.createDataFrame([(s,) for s in accept], "state string")
    goals = nodes.where(F.col("kind").isin(*target_kinds)).select("id", F.col("kind").alias("target_kind"))
    ends = both.select("dst").distinct().join(states, F.col("dst.state") == F.col("state"), "left_semi").join(goals, F.col("dst.id") == F.col("id"), "left_semi")
    ends = cut(ends.select(F.col("dst").alias("id")), "ends")
    back = both.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    left = cut(graphs.distances(back, ends.select(F.lit(0).alias("seed"), "id"), depth).select("id", F.col("dist").alias("left")), "left")

    levels = _reach(both, first.select(F.col("id").alias("seed"), F.struct("id", "state").alias("id")), left, ends, depth)
    hit = None
    for level, hops in enumerate(levels, 1):
        new = hops.select("seed", F.col("dst").alias("id")).distinct().join(ends, "id", "left_semi").select("seed", F.col("id.id").alias("target"), F.lit(level).alias("dist"), "id")
        hit = new if hit is None else hit.union(new)
    if hit is None:
        hit = both.select(F.col("src.id").alias("seed"), F.col("dst.id").alias("target"), F.lit(0).alias("dist"), F.col("dst").alias("id")).limit(0)
    nearest = hit.groupBy("seed", "target").agg(F.min("dist").alias("dist"))
    hit = cut(hit.join(nearest, ["seed", "target", "dist"]), "hits")
    found = _rebuilt(dict(both.dtypes)["edge_id"], levels, hit).join(goals.withColumnRenamed("id", "target"), "target")
    found = found.where(F.size(F.array_distinct("nodes")) == F.size("nodes")).select("seed", "target", "target_kind", F.col("hops"), "nodes", "edges")
    return found if limit is None else found.orderBy("target_kind", "target", "hops", "nodes", "edges").limit(limit)


def _reach(both: DataFrame, first: DataFrame, left: DataFrame, ends: DataFrame, depth: int) -> list[DataFrame]:
    """By level, the arcs (seed, src, dst, edge_id) over which first(seed, id) reaches what it has not reached before, if a target is within
    what is left of depth: the shortest ways of every seed, and nothing of other seeds' arcs.

    A node that is no target and from which the only way on is back is not entered: no shortest path passes it.
    """
    pairs = both.select("src", "dst").distinct()
    out = pairs.groupBy("src").agg(F.count("*").alias("_n"), F.min("dst").alias("_only")).where("_n = 1")
    alone = out.join(ends, out["src"] == ends["id"], "left_anti").select(F.col("src").alias("dst"), F.col("_only").alias("src"))
    steps = both.join(left.withColumnRenamed("id", "dst"), "dst").join(alone, ["src", "dst"], "left_anti").select("src", "dst", "edge_id", "left")
    steps = cut(steps, "steps")
    reached = frontier = cut(first.join(left, "id").where(F.col("left") <= depth).select("seed", "id"), "reach")
    levels = []
    for level in range(1, depth + 1):
        new = frontier.join(steps.where(F.col("left") <= depth - level), frontier["id"] == steps["src"]).select("seed", "src", "dst", "edge_id")
        new = cut(new.join(reached.withColumnRenamed("id", "dst"), ["seed", "dst"], "left_anti").select("seed", "src", "dst", "edge_id"), "reach")
        if new.isEmpty():
            break
        levels.append(new)
        frontier = new.select("seed", F.col("dst").alias("id")).distinct()
        reached = reached.union(frontier)
    return levels


def _rebuilt(kind: str, levels: list[DataFrame], hit: DataFrame) -> DataFrame:
    """All paths back from hit(seed, target, dist, id) over the arcs by which their own seed came: (seed, target, hops, nodes, edges)."""
    hits = hit.select("seed", "target", F.col("dist").alias("hops"), F.col("id").alias("at"), F.array("id.id").alias("nodes"), F.array().cast(f"array<{kind}>").alias("edges"))
    walk = None
    for level in range(len(levels), 0, -1):
        new = hits.where(F.col("hops") == level)
        walk = new if walk is None else walk.union(new)
        step = walk.join(levels[level - 1].withColumnRenamed("dst", "at"), ["seed", "at"])
        step = step.select("seed", "target", "hops", F.col("src").alias("at"), F.concat(F.array("src.id"), "nodes").alias("nodes"), F.concat(F.array("edge_id"), "edges").alias("edges"))
        walk = cut(step, "walk")
    return (hits.limit(0) if walk is None else walk).select("seed", "target", "hops", "nodes", "edges")


def path_id(nodes: Column, edges: Column) -> Column:
    """The content address of a path."""
    return F.sha2(F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges"))).cast("binary"), 256)


def normalised(paths: DataFrame, changed: DataFrame) -> DataFrame:
    """One row by path (path_id, seed, target, hops, nodes, edges, symbols): symbols are those of changed(seed, symbol) at its seed, in order and
    once each; empty where nothing that changed seeds the path."""
    own = changed.where("symbol is not null").groupBy("seed").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    d = paths.withColumn("path_id", path_id(F.col("nodes"), F.col("edges"))).dropDuplicates(["path_id"]).join(own, "seed", "left")
    return d.select("path_id", "seed", "target", "hops", "nodes", "edges", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


def candidates(paths: DataFrame, nodes: DataFrame, edges: DataFrame, operations: DataFrame, target_kinds: tuple, intermediate: bool = True) -> DataFrame:
    """Impact candidates (as operators/impact.py reads them) of paths(seed, nodes, edges): one for each path and operation of its seed in
    operations(seed, operation), ending at the path's last node or, with intermediate, at each node of a target kind on the way.

    nodes has (id, kind, title, tier, review, application_id, revision), edges (edge_id, src, dst, type, tier, review, application_id, revision,
    stale, evidence_ids, conflict_ids). Beginnings that several paths share are one candidate.
    """
    p = cut(paths.withColumn("path_id", path_id(F.col("nodes"), F.col("edges"))).select("path_id", "seed", "nodes", "edges").dropDuplicates(["path_id"]), "found-paths")
    node = F.struct("pos", F.struct("id", "kind", "tier", "review", "application_id", "revision").alias("v"), "title")
    on = p.select("path_id", F.posexplode("nodes").alias("pos", "id")).join(nodes.dropDuplicates(["id"]), "id").groupBy("path_id").agg(F.sort_array(F.collect_list(node)).alias("_n"))
    hop = F.struct("pos", F.struct("type", F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "tier", "review", "application_id", "revision", "stale", "evidence_ids", "conflict_ids").alias("v"))
    over = p.select("path_id", F.posexplode("edges").alias("pos", "edge_id")).join(edges.dropDuplicates(["edge_id"]), "edge_id").groupBy("path_id").agg(F.sort_array(F.collect_list(hop)).alias("_h"))
    d = p.join(on, "path_id").join(over, "path_id").join(operations.select("seed", "operation"), "seed")
    last = F.size("_h")
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(1), last) if intermediate else F.array(last)))
    target = F.get("_n", F.col("_i"))
    d = d.where(target["v"]["kind"].isin(*target_kinds))
    ident = F.sha2(F.to_json(F.struct("operation", F.slice("nodes", 1, F.col("_i") + 1).alias("n"), F.slice("edges", 1, F.col("_i")).alias("e"))).cast("binary"), 256)
    d = d.select(
        ident.alias("candidate_id"), F.col("seed").alias("seed_id"), "operation", target["v"]["id"].alias("target_id"), target["v"]["kind"].alias("target_kind"), target["title"].alias("title"),
        F.transform(F.slice("_n", F.lit(1), F.col("_i") + 1), lambda x: x["v"]).alias("nodes"), F.transform(F.slice("_h", F.lit(1), F.col("_i")), lambda x: x["v"]).alias("hops"),
    )
    return d.dropDuplicates(["candidate_id"])
