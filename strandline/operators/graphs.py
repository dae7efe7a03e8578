"""Graph operators over edge tables (src, dst): level-by-level joins, never a whole graph in one place.

Loops run on the driver and build one plan a level; each level is written to the shared folder, so plans stay short and
a lost executor costs one level. Edges are written once and scanned by every level; a level's frontier holds only nodes
that were not reached before (an anti join), so no edge is followed twice. Filter edges by type, tier or review
before calling: the paths found are then the shortest among eligible ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.tables import cut, deal, dealt_groups, drop, forget

#: Edges that a task of the component search is given.
EDGES_OF_A_TASK = 1 << 19
#: Edges that a task merges into stars at once before the component search.
EDGES_OF_A_MERGE = 1 << 20
#: Up to so many ids of a level are given to every task of the closure with reasons, in place of dealing all edges again.
IDS_OF_A_BROADCAST = 1 << 16


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, other columns kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def distances(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, dist) of every node within depth of each of seeds(seed, id); seeds are at distance 0."""
    return _levels(cut(edges.select("src", "dst"), "steps"), seeds, depth)


def _levels(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """distances over edges that are written already, so no level works them out again; double edges cost no more than a row."""
    reached = cut(seeds.select("seed", "id").distinct().withColumn("dist", F.lit(0)), "reached")
    frontier = reached
    every = [reached]
    for level in range(1, depth + 1):
        new = frontier.join(steps, frontier["id"] == steps["src"]).select("seed", F.col("dst").alias("id")).distinct()
        before = every[0]
        for d in every[1:]:
            before = before.union(d)
        frontier = cut(new.join(before, ["seed", "id"], "left_anti").withColumn("dist", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        every.append(frontier)
    out = every[0]
    for d in every[1:]:
        out = out.union(d)
    return out


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, node_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, dist) within depth of any seed, nearest first where a limit is asked for, and the edges among them."""
    d = distances(edges, seeds.select(F.lit(0).alias("seed"), "id"), depth).select("id", "dist")
    if node_limit is not None:
        d = d.orderBy("dist", "id").limit(node_limit)
    nodes = cut(d, "nodes")
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, inside


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(source, target, hops, nodes) of all shortest paths from each of sources(id) to each of targets(id).

    Distances are found first; paths then grow only over edges that come one level nearer to a target that is reached,
    back from the target, so no walk is kept that leads nowhere.
    """
    steps = cut(edges.select("src", "dst").distinct(), "steps")
    d = cut(_levels(steps, sources.select(F.col("id").alias("seed"), "id"), depth), "distances")
    ends = d.join(targets.select("id").distinct(), "id", "left_semi").where("dist > 0")
    paths = ends.select("seed", F.col("id").alias("target"), F.col("dist").alias("hops"), F.col("id").alias("at"), "dist", F.array("id").alias("nodes"))
    done = None
    far = ends.agg(F.max("dist")).first()[0] or 0
    for _ in range(far):
        back = paths.join(steps, paths["at"] == steps["dst"]).select("seed", "target", "hops", F.col("src").alias("at"), (F.col("dist") - 1).alias("dist"), "nodes")
        near = d.select("seed", F.col("id").alias("at"), "dist")
        grown = back.join(near, ["seed", "at", "dist"], "left_semi").withColumn("nodes", F.concat(F.array("at"), "nodes"))
        grown = cut(grown, "paths")
        whole = grown.where("dist = 0").select(F.col("seed").alias("source"), "target", "hops", "nodes")
        done = whole if done is None else done.union(whole)
        paths = grown.where("dist > 0")
    if done is None:
        done = paths.select(F.col("seed").alias("source"), "target", "hops", "nodes").limit(0)
    return done


def trails(edges: DataFrame, start: DataFrame, end: DataFrame, depth: int, enough: int | None = None) -> DataFrame:
    """(start, finish, nodes, edges) of all trails of at most depth edges: no edge twice, nodes may recur.

    edges has (edge_id, src, dst). Trails are exponential by nature; a step is kept only if some end can still be reached
    within what is left (one distance a node, back from the nearest end), which drops every walk that cannot finish. The shortest
    come first, so with enough the search stops after the level that has brought so many.
    """
    both = cut(symmetrise(edges.select("src", "dst", "edge_id")), "both")
    ends = cut(end.select("id").distinct(), "ends")
    left = cut(_levels(both, ends.select(F.lit(0).alias("seed"), "id"), depth).select(F.col("id").alias("at"), "dist"), "left")
    walk = start.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("nodes")).join(left, "at").where(F.col("dist") <= depth)
    walk = walk.select("start", "at", "nodes", F.array().cast(f"array<{dict(edges.dtypes)['edge_id']}>").alias("edges"))
    out, n = None, 0
    for used in range(1, depth + 1):
        step = walk.join(both, walk["at"] == both["src"]).where(~F.array_contains("edges", F.col("edge_id")))
        step = step.select("start", F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"))
        walk = cut(step.join(left, "at").where(F.col("dist") <= depth - used).select(*step.columns, (F.col("dist") == 0).alias("ended")), "trails")
        found = walk.where("ended").select("start", F.col("at").alias("finish"), "nodes", "edges")
        out = found if out is None else out.union(found)
        n += found.count() if enough is not None else 0
        if enough is not None and n >= enough or walk.isEmpty():
            break
        walk = walk.drop("ended")
    return out


def closure(depends: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of everything that depends, directly or not, on a seed; depends has (id, on_id). Seeds are included."""
    depends = cut(depends.select("id", "on_id"), "depends")
    reached = cut(seeds.select("id").distinct(), "affected")
    frontier = reached
    while True:
        new = frontier.select(F.col("id").alias("on_id")).join(depends, "on_id").select("id").distinct()
        frontier = cut(new.join(reached, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return reached
        reached = reached.union(frontier)


def closure_with_reasons(depends: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, hop, reason, via) of everything that depends, directly or not, on a seed of seeds(id, reason); depends has (id, on_id, reason).

    hop is the least number of steps, reason and via (what it depends on there; null for seeds) the least pair among those that reach it in
    so many. Depends that loop end: a level takes only what was not reached before.
    """
    depends = cut(depends.select("id", "on_id", F.col("reason").alias("_why")), "depends")
    seeds = cut(seeds.where("id is not null").select("id", "reason", F.lit(None).cast(dict(depends.dtypes)["on_id"]).alias("via")), "seeds")
    tasks = (depends.count() + seeds.count()) // EDGES_OF_A_TASK + 1
    least = lambda d: d.repartition(tasks, "id").groupBy("id").agg(F.min(F.struct("reason", "via")).alias("_r")).select("id", "_r.reason", "_r.via")
    frontier = cut(least(seeds).select("id", F.lit(0).alias("hop"), "reason", "via"), "affected")
    reached = frontier
    hop = 0
    while n := frontier.count():
        hop += 1
        at = frontier.select(F.col("id").alias("on_id"))
        if n <= IDS_OF_A_BROADCAST:
            new = depends.join(F.broadcast(at), "on_id")
        else:
            new = depends.repartition(tasks, "on_id").join(at.repartition(tasks, "on_id").hint("shuffle_hash"), "on_id")
        new = least(new.select("id", F.col("_why").alias("reason"), F.col("on_id").alias("via")))
        new = new.join(reached.select("id").repartition(tasks, "id").hint("shuffle_hash"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "reason", "via")
        frontier = cut(new, "affected")
        reached = reached.union(frontier)
    return reached


def lineage(df: DataFrame, ident: str, parent: str, depth: int) -> DataFrame:
    """(ident, root, hops): the last ancestor within depth steps. Pointers double, so the joins are log2(depth)."""
    p = df.where(F.col(parent).isNotNull()).select(F.col(ident).alias("id"), F.col(parent).alias("up"))
    known = df.select(F.col(ident).alias("up"))
    d = cut(p.join(known, "up", "left_semi").select("id", "up", F.lit(1).alias("hops")), "lineage")  # parents that exist
    jump, at = d, df.select(F.col(ident).alias("id"), F.col(ident).alias("root"), F.lit(0).alias("hops"))
    left = depth
    while left:
        if left & 1:
            j = jump.select(F.col("id").alias("root"), F.col("up").alias("_up"), F.col("hops").alias("_more"))
            at = at.join(j, "root", "left").select("id", F.coalesce("_up", "root").alias("root"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"))
        left >>= 1
        if left:  # a chain that ends early keeps its last pointer
            far = jump.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_more"))
            jump = cut(jump.join(far, "up", "left").select("id", F.coalesce("_up", "up").alias("up"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops")), "jump")
    return at.select(F.col("id").alias(ident), "root", "hops")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component), roots left out, of the edges u-v."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _merge(batches):
    """Stars of a task's edges. As long as they are few they are kept and merged with the edges that follow."""
    held, n = [], 0
    for b in batches:
        held.append(tuple(np.asarray(b.column(i), np.int64) for i in (0, 1)))
        n += b.num_rows
        if n >= EDGES_OF_A_MERGE:
            held = [stars(*map(np.concatenate, zip(*held)))]
            n = len(held[0][0])
            if 2 * n > EDGES_OF_A_MERGE:
                yield _rows(*held[0])
                held, n = [], 0
    if n:
        yield _rows(*stars(*map(np.concatenate, zip(*held))))


def _rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges(src, dst): the smallest id it reaches. Nulls and loops are no edges.

    Large-star and small-star steps in turn: minima and joins on the node, so a hub is a skewed key of one join
    side that is streamed and no neighbour list is gathered; the rounds grow with the logarithm of the longest path. Before the
    first step each task merges its own edges of whole numbers into stars (union-find over EDGES_OF_A_MERGE at once).

    Rows are dealt by number before they are grouped: written ids pack so well that a task which grouped what it had scanned
    held tens of millions of them. The tables of a step, and its shuffle files if it has many edges, go once the next step is written, so
    the disk holds those of one step and not of all rounds.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v")
    if all(t in ("bigint", "int") for _, t in e.dtypes):
        e = e.selectExpr("cast(u as bigint) u", "cast(v as bigint) v").mapInArrow(_merge, "u bigint, v bigint")
    e = cut(e, "edges")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tasks = state[0] // EDGES_OF_A_TASK + 1
        if state == seen:
            break
        seen = state
        if tasks > 1:
            forget(spark)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(tasks, "u")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).hint("shuffle_hash")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        met = cut(large.repartition(tasks, "u").distinct(), "stars")
        drop(e)
        if tasks > 1:
            forget(spark)
        large = met.repartition(tasks, "u")
        low = large.groupBy("u").agg(F.min("v").alias("m")).hint("shuffle_hash")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        e = cut(small.repartition(tasks, "u", "v").distinct(), "edges")
        drop(met)
    roots = e.select("v").repartition(tasks, "v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    out = e.repartition(tasks, "u").groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(roots)
    out._written = getattr(e, "_written", None)  # who has written the result may drop it
    return out


def reached(edges: DataFrame | list[DataFrame], seeds: DataFrame, depths: list[int]) -> DataFrame:
    """(id, searches) of what several searches over edges(src, dst, searches) reach from seeds(id, searches), for search k in at most depths[k] steps.

    Bit k of searches stands for search k: those that may follow an edge, those that start at a seed, those that reach an id they did not start
    at. An id has a row for each level at which a search reaches it first. Edges are dealt by src and written once, for all levels and
    searches; of several tables of edges, one after another. They stream past the ids that a task holds, so it is given more of them. What a
    task finds at an id is put together before it is dealt, and the shuffle files of a level go before the next.
    """
    spark = seeds.sparkSession
    edges = [d.where("searches <> 0 and src is not null and dst is not null").select("src", "dst", "searches") for d in (edges if isinstance(edges, list) else [edges])]
    seeds = seeds.where("searches <> 0 and id is not null").select("id", "searches")
    tasks = (sum(d.count() for d in edges) // 2 + seeds.count()) // EDGES_OF_A_TASK + 1
    edges = deal(edges, "ways", tasks, "src")
    frontier = cut(seeds.repartition(tasks, "id").groupBy("id").agg(F.bit_or("searches").alias("searches")), "frontier")
    seen, out = frontier, frontier.limit(0)
    for level in range(1, max(depths) + 1):
        going = sum(1 << k for k, depth in enumerate(depths) if level <= depth)
        at = frontier.select(F.col("id").alias("src"), F.col("searches").bitwiseAND(F.lit(going)).alias("_at")).where("_at <> 0")
        at = F.broadcast(at) if frontier.count() <= IDS_OF_A_BROADCAST else at.repartition(tasks, "src").hint("shuffle_hash")
        new = edges.join(at, "src").select(F.col("dst").alias("id"), F.col("searches").bitwiseAND(F.col("_at")).alias("new"), F.lit(0).alias("old")).where("new <> 0")
        every = new.union(seen.select("id", F.lit(0).alias("new"), F.col("searches").alias("old")))
        every = every.groupBy("id").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        with dealt_groups(spark, tasks):
            frontier = cut(every.select("id", F.expr("new & ~old").alias("searches")).where("searches <> 0"), "frontier")
        if tasks > 1:
            forget(spark)
        if frontier.isEmpty():
            break
        seen, out = seen.union(frontier), out.union(frontier) if level > 1 else frontier
    drop(edges)
    return out


def without_path(starts: DataFrame, edges: DataFrame, kinds: Column, depth: int) -> DataFrame:
    """(id) of starts that reach no node of the wanted kind within depth; edges has (src, dst, dst_kind).

    One search from all wanted nodes back over the edges answers every start at once: its frontier holds each node once,
    however many starts there are.
    """
    steps = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    goal = edges.where(kinds).select(F.col("dst").alias("id")).distinct().select(F.lit(0).alias("seed"), "id")
    near = distances(steps, goal, depth).select("id", "dist")
    return starts.select("id").join(near.where("dist > 0").select("id"), "id", "left_anti")
