"""Regular path search, impact candidates and refresh plans against plain Python, with every caveat planted."""

from __future__ import annotations

import random
from collections import defaultdict


from pyspark.sql import functions as F

from strandline.operators import graphs, impact, links, paths, refresh

STEPS = [("s", "A", "x", "y", "forward", "t"), ("s", "B", "x", "x", "any", "s"), ("t", "A", "y", "x", "reverse", "u"), ("t", "C", "y", "z", "forward", "t"), ("u", "B", "x", "z", "any", "t"), ("t", "B", "z", "y", "reverse", "t")]


def plain_search(nodes: dict, edges: list, seeds, steps, kinds, depth, start, accept):
    arcs = defaultdict(list)
    for eid, a, b, typ in edges:
        for way, u, v in (("forward", a, b), ("reverse", b, a)):
            for st, t, ku, kv, w, nxt in steps:
                if t == typ and w in (way, "any") and nodes.get(u) == ku and nodes.get(v) == kv:
                    arcs[u, st].append((eid, v, nxt))
    out = set()
    for s in seeds:
        walks, found, dist = [((s, start), (s,), ())], {}, {(s, start): 0}
        for level in range(1, depth + 1):
            new = []
            for at, ns, es in walks:
                for eid, v, nxt in set(arcs[at]):
                    if dist.setdefault((v, nxt), level) == level:
                        new.append(((v, nxt), (*ns, v), (*es, eid)))
            walks = new
            for (v, st), ns, es in walks:
                if st in accept and nodes[v] in kinds and found.setdefault(v, level) == level and len(set(ns)) == len(ns):
                    out.add((s, v, level, ns, es))
    return out


def test_search_equals_plain_python(spark):
    rng = random.Random(4)
    for round_ in range(3):
        nodes = {f"n{i}": rng.choice("xyz") for i in range(40)}
        edges = [(i, f"n{rng.randrange(42)}", f"n{rng.randrange(42)}", rng.choice("ABC")) for i in range(260)]  # some ends are missing
        seeds = [f"n{i}" for i in range(0, 40, 5)] + ["nowhere"]
        n = spark.createDataFrame(list(nodes.items()), "id string, kind string")
        e = spark.createDataFrame(edges + edges[:20], "edge_id int, src string, dst string, type string")  # repeated rows
        got = paths.search(n, e, spark.createDataFrame([(s,) for s in seeds + seeds[:2]], "id string"), STEPS, ("y", "z"), 4, "s", ("t", "u"))
        rows = [(r["seed"], r["target"], r["hops"], tuple(r["nodes"]), tuple(r["edges"])) for r in got.collect()]
        want = plain_search(nodes, edges, [s for s in seeds if s in nodes], STEPS, "yz", 4, "s", ("t", "u"))
        assert len(rows) == len(set(rows)) and set(rows) == want and want, round_
    assert paths.search(n, e.limit(0), n.select("id"), STEPS, ("y",), 4, "s", ("t",)).count() == 0
    assert [r["hops"] for r in paths.search(n, e, n.select("id"), STEPS, ("y", "z"), 4, "s", ("t", "u"), limit=3).collect()][0] == 1


def test_a_hub_is_not_walked_for_every_pair(spark, monkeypatch):
    """Of n seeds at one hub each writes its own few rows, not one for every other seed; what no seed comes near is not written at all."""
    written, cut = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda d, name: (written.append((name, t := cut(d, name))), t)[1])
    n = 1_500
    nodes = spark.range(n).selectExpr("concat('s', id) as id", "'s' as kind").union(spark.createDataFrame([("hub", "n"), ("top", "r"), ("far", "n")], "id string, kind string")).union(spark.range(n).selectExpr("concat('f', id)", "'s'"))
    edges = spark.range(n).selectExpr("id as edge_id", "concat('s', id) as src", "'hub' as dst", "'IN' as type").union(spark.range(n).selectExpr("id + 5000", "concat('f', id)", "'far'", "'IN'")).union(spark.createDataFrame([(9000, "hub", "top", "UP")], "edge_id long, src string, dst string, type string"))
    seeds = spark.range(n).selectExpr("concat('s', id) as id")
    found = paths.search(nodes, edges, seeds, paths.one_state((("IN", "s", "n", "any"), ("IN", "n", "s", "any"), ("UP", "n", "r", "forward"))), ("r",), 4)
    assert found.count() == n and found.where("hops = 2 and nodes[1] = 'hub'").count() == n
    assert max(t.count() for _, t in written) <= 4 * n and any(name == "walk" for name, _ in written)


NODE = "struct<id:string,kind:string,tier:string,review:string,application_id:string,revision:int>"
HOP = "struct<type:string,from_id:string,to_id:string,tier:string,review:string,application_id:string,revision:int,stale:boolean,evidence_ids:array<string>,conflict_ids:array<string>>"


def test_every_caveat_is_seen(spark):
    """Each edge or node below is wrong in one way; the candidates that cross it carry that code."""
    n = [(f"a{i}", "code-symbol", "", "A", "accepted", "app", 1) for i in range(14)] + [("s", "screen", "Screen", "A", "accepted", "app", 1), ("u", "ui-element", "Button", "A", "accepted", "app", 1), ("w", "code-file", "", "A", "accepted", "app", 1)]
    n += [("foreign", "code-symbol", "", "A", "accepted", "other", 1), ("d", "code-symbol", "", "D", "accepted", "app", 1)]
    node = {x[0]: (x[0], x[1], *x[3:]) for x in n}
    hop = lambda a, b, typ="CALLS", tier="A", review="accepted", rev=1, stale=False, conflicts=(): (typ, a, b, tier, review, "app", rev, stale, ["e"], list(conflicts))
    ui = hop("u", "a0", "BINDS")
    cand = {
        "fine": (["a0", "u"], [ui], "ui-element"),
        "foreign_application": (["foreign", "a0", "u"], [hop("foreign", "a0"), ui], "ui-element"),
        "stale_revision": (["a1", "a0", "u"], [hop("a1", "a0", stale=True), ui], "ui-element"),
        "depth_exceeded": ([f"a{i}" for i in range(11, -1, -1)] + ["u"], [hop(f"a{i}", f"a{i - 1}") for i in range(11, 0, -1)] + [ui], "ui-element"),
        "cycle_detected": (["a1", "a0", "a1", "a0", "u"], [hop("a1", "a0")] * 3 + [ui], "ui-element"),
        "unsupported_target": (["a0", "a1"], [hop("a0", "a1")], "code-symbol"),
        "disconnected_path": (["a1", "a0", "u"], [hop("a1", "a2"), ui], "ui-element"),
        "invalid_direction": (["a0", "s"], [hop("a0", "s", "RENDERED_BY")], "screen"),
        "tier_d_evidence": (["d", "a0", "u"], [hop("d", "a0"), ui], "ui-element"),
        "evidence_conflict": (["a1", "a0", "u"], [hop("a1", "a0", conflicts=["c"]), ui], "ui-element"),
        "review_unresolved": (["a1", "a0", "u"], [hop("a1", "a0", tier="C", review="not_required"), ui], "ui-element"),
    }
    rows = [(k, [node[i] for i in ns], hs, kind) for k, (ns, hs, kind) in cand.items()]
    df = spark.createDataFrame(rows, f"candidate_id string, nodes array<{NODE}>, hops array<{HOP}>, target_kind string")
    codes = {r["candidate_id"]: r["codes"] for r in impact.caveats(df, "app", 1).collect()}
    assert codes.pop("fine") == [] and all(k in v for k, v in codes.items())
    assert set(codes) <= set().union(*codes.values()) and codes["disconnected_path"] == ["disconnected_path", "invalid_direction"]


def test_candidates_of_found_paths(spark):
    kinds = {"f": "code-symbol", "g": "code-symbol", "b": "ui-element", "s": "screen", "x": "flow-step", "w": "workflow"}
    nodes = spark.createDataFrame([(i, k, i.upper(), "A", "accepted", "app", 1) for i, k in kinds.items()], "id string, kind string, title string, tier string, review string, application_id string, revision int")
    edges = [("1", "f", "g", "CALLS", "A", []), ("2", "b", "g", "BINDS", "B", []), ("3", "s", "b", "CONTAINS", "A", []), ("4", "x", "b", "ACTS_ON", "A", []), ("5", "w", "x", "HAS_STEP", "A", ["c"]), ("6", "g", "f", "CALLS", "A", [])]
    e = spark.createDataFrame([(*r[:5], "accepted", "app", 1, False, [r[0]], r[5]) for r in edges], "edge_id string, src string, dst string, type string, tier string, review string, application_id string, revision int, stale boolean, evidence_ids array<string>, conflict_ids array<string>")
    seeds = spark.createDataFrame([("f",)], "id string")
    found = paths.search(nodes, e, seeds, paths.one_state(impact.STEPS), impact.TARGET_KINDS, 10)
    assert {(r["target"], tuple(r["edges"])) for r in found.collect()} == {(t, (first, *rest)) for first in "16" for t, rest in (("b", "2"), ("s", "23"), ("w", "245"))}
    cand = paths.candidates(found, nodes, e, spark.createDataFrame([("f", "modified"), ("f", "deleted")], "seed string, operation string"), impact.TARGET_KINDS)
    assert cand.count() == 12  # two paths to each of three targets, two operations; shared beginnings count once
    flagged = impact.caveats(cand, "app", 1)
    assert {(r["target_id"], tuple(r["codes"])) for r in flagged.collect()} == {("b", ()), ("s", ()), ("w", ("evidence_conflict",))}
    risk = spark.createDataFrame([("b", "high"), ("s", "low")], "target_id string, risk string")
    sc = impact.scenarios(flagged.where(F.size("codes") == 0), risk).collect()
    assert {(r["target_id"], r["kind"], r["workflow_id"], r["requirement_id"], tuple(r["checkpoint_ids"]), r["priority"]) for r in sc} == {("b", "ui_interaction", None, None, ("b",), "high"), ("s", "ui_interaction", None, None, ("b", "s"), "low")}
    assert len(sc) == len({r["scenario_id"] for r in sc}) == 4  # two relationships reach g; both operations of a path are one scenario
    assert impact.scenarios(flagged, risk, limit=1).count() == 2 and impact.scenarios(flagged.limit(0), risk).count() == 0
    got = paths.normalised(found, spark.createDataFrame([("f", "z"), ("f", "a"), ("f", "a"), ("g", "q"), ("f", None)], "seed string, symbol string"))
    assert {tuple(r["symbols"]) for r in got.collect()} == {("a", "z")} and got.select("path_id").distinct().count() == 6
    assert {tuple(r["symbols"]) for r in paths.normalised(found, spark.createDataFrame([], "seed string, symbol string")).collect()} == {()}


def test_trails_stop_at_the_level_that_is_enough(spark):
    edges = [(1, "a", "m"), (2, "m", "b"), (3, "a", "n"), (4, "n", "b"), (5, "a", "b"), (6, "b", "c"), (7, "z", "a")]
    e = spark.createDataFrame([(*x, "T", "A", "accepted") for x in edges], "edge_id int, src string, dst string, type string, tier string, review_state string")
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    every = graphs.trails(e.select("edge_id", "src", "dst"), one("a"), one("b", "c", "nowhere"), 4)
    shortest = sorted((len(r["edges"]), r["edges"]) for r in every.collect())
    for n in (1, 2, 3, 5, len(shortest)):
        assert [(r["hops"], r["edges"]) for r in links.evidence_paths(e, one("a"), one("b", "c", "nowhere"), 4, n).collect()] == shortest[:n]


def test_closure_keeps_the_least_reason(spark):
    depends = [("b", "a", "calls"), ("b", "a", "binds"), ("c", "b", "calls"), ("c", "a2", "zzz"), ("d", "c", "calls"), ("a", "d", "loop"), (None, "a", "lost"), ("e", None, "lost"), ("b", "b", "self")]
    seeds = [("a", "changed"), ("a", "a first"), ("a2", "changed"), (None, "nothing")]
    got = graphs.closure_with_reasons(spark.createDataFrame(depends, "id string, on_id string, reason string"), spark.createDataFrame(seeds, "id string, reason string"))
    assert {tuple(r) for r in got.where("id is not null").collect()} == {("a", 0, "a first", None), ("a2", 0, "changed", None), ("b", 1, "binds", "a"), ("c", 1, "zzz", "a2"), ("d", 2, "calls", "c")}


def test_refresh_plan(spark):
    entities = [("f", "code-file", ["src/a/b.ts"], [], False), ("g", "code-file", ["src/a"], ["f"], None), ("h", "code-file", ["src/abc.ts"], None, False), ("w", "workflow", None, ["g", "r2", "gone"], False),
                ("r1", "requirement", [None], ["w"], False), ("r2", "requirement", [], [], False), ("r3", "requirement", [], [], False), ("old", "screen", [], [], True), ("free", "workflow", [], ["r3"], False)]
    links_ = [("l1", "r3", "w", "COVERED_BY", "accepted", []), ("l2", "h", "r2", "X", "accepted", None), ("l3", "h", "r2", "X", "pending", []), ("l4", "h", "r2", "X", "accepted", ["src/a/b.ts/x"]), ("l5", "f", "h", "X", "accepted", []), ("l6", None, None, "X", None, None)]
    e = spark.createDataFrame(entities, "id string, kind string, source_paths array<string>, depends_on_ids array<string>, stale boolean")
    li = spark.createDataFrame(links_, "id string, from_id string, to_id string, relationship string, review_state string, source_paths array<string>")
    c = spark.createDataFrame([("src/a/b.ts",), (None,)], "path string")
    got = {(r["subject"], r["id"]): (r["outcome"], r["reason"], r["hop"]) for r in refresh.plan(e, li, c).collect()}
    assert got == {
        ("entity", "f"): ("affected", "source_changed", 0), ("entity", "g"): ("affected", "source_changed", 0), ("entity", "h"): ("reused", None, None), ("entity", "w"): ("affected", "depends_on_affected", 1),
        ("entity", "r1"): ("affected", "depends_on_affected", 2), ("entity", "r2"): ("reused", None, None), ("entity", "r3"): ("reused", None, None), ("entity", "old"): ("affected", "stale", 0), ("entity", "free"): ("reused", None, None),
        ("link", "l1"): ("invalidated", "to_affected", None), ("link", "l2"): ("reusable", None, None), ("link", "l3"): ("unreviewed", None, None), ("link", "l4"): ("invalidated", "source_changed", None),
        ("link", "l5"): ("invalidated", "from_affected", None), ("link", "l6"): ("unreviewed", None, None),
        ("requirement", "r1"): ("reassess", "affected", 2), ("requirement", "r2"): ("reassess", "workflow_depends_on_it", None), ("requirement", "r3"): ("reassess", "covered_by_workflow", None),
    }
    assert refresh.plan(e.limit(0), li.limit(0), c.limit(0)).count() == 0
