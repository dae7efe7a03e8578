"""Keyed state, name resolution and reports on hand-made tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandline.operators import reports, resolution as op, rows


def test_upsert_prefers_version_then_incoming(spark):
    cols = "k string, v string, version int"
    e = spark.createDataFrame([("a", "old", 2), ("b", "old", 1), ("c", "old", 1)], cols)
    i = spark.createDataFrame([("a", "new", 1), ("b", "new", 1), ("d", "new", 0), ("c", "x", None)], cols)
    assert {tuple(r) for r in op.upsert(e, i, ["k"], ["version"]).collect()} == {("a", "old", 2), ("b", "new", 1), ("c", "old", 1), ("d", "new", 0)}


def test_insert_missing_takes_the_first_delivery(spark):
    e, i = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 5), (2, 9), (2, 3)], "k int, at int")
    assert [tuple(r) for r in op.insert_missing(e, i, ["k"], ["at"]).collect()] == [(2, 3)]


def test_frontier_keeps_status_and_first_sighting(spark):
    b = spark.createDataFrame([("u", "done", 5, 1), ("v", "pending", 6, 1)], "url string, status string, seen int, priority int")
    f = spark.createDataFrame([("u", 9, 7), ("w", 8, 2), ("w", 7, 3)], "url string, seen int, priority int")
    got = {(r["url"], r["status"], r["seen"], r["priority"]) for r in op.merge_frontier(b, f, "url", 10).collect()}
    assert got == {("u", "done", 5, 7), ("v", "pending", 6, 1), ("w", "pending", 7, 3)}


def test_inheritance_survives_cycles(spark):
    c = spark.createDataFrame([("A", "Base"), ("B", "a"), ("C", "D"), ("D", "C"), ("E", "B"), ("E", None)], "name string, parent string")
    assert {r["name"] for r in op.inherits(c, "BASE").collect()} == {"A", "B", "E"}


def test_inheritance_has_no_depth_limit(spark):
    c = spark.createDataFrame([("N0", "Base")] + [(f"N{i}", f"n{i - 1}") for i in range(1, 70)], "name string, parent string").coalesce(1)
    assert op.inherits(c, "base").count() == 70


def test_routes_prefer_literals_and_keep_ties(spark):
    routes = spark.createDataFrame([(p,) for p in ("/a/:x", "/a/b", "/[y]/b", "/{z}/{w}", "/a/*", "/*", "/", "/a/[...rest]")], "pattern string")
    asks = spark.createDataFrame([(1, "/a/b"), (2, "/a/c"), (3, "/q/b"), (4, "/a/b/c"), (5, "/"), (6, "/x"), (7, "/q/r")], "id int, path string")
    got: dict[int, set] = {}
    for r in op.match_routes(asks, routes, "path", "id").collect():
        got.setdefault(r["id"], set()).add(r["pattern"])
    assert got == {1: {"/a/b"}, 2: {"/a/:x"}, 3: {"/[y]/b"}, 4: {"/a/*", "/a/[...rest]"}, 5: {"/"}, 6: {"/*"}, 7: {"/{z}/{w}"}}


def test_depth_never_falls_below_zero(spark):
    rng = random.Random(8)
    data = [(g, i, rng.choice([-1, 1, 0])) for g in range(10) for i in range(30)]
    want = {}
    for g in range(10):
        depth = branches = 0
        for _, _, s in sorted(x for x in data if x[0] == g):
            depth, branches = max(0, depth + s), branches + (s < 0)
        want[g] = (depth, branches)
    got = op.clamped_depth(spark.createDataFrame(data, "g int, i int, s int"), "g", ["i"], F.col("s")).collect()
    assert {r["g"]: (r["depth"], r["branches"]) for r in got} == want


def test_comparison_needs_a_baseline(spark):
    plan = spark.createDataFrame([(m, c) for m in (1, 2, 3) for c in ("x", "y")], "m int, c string")
    base = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1)], "m int, c string, v int")
    head = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1), (2, "y", 2), (3, "x", 1)], "m int, c string, v int")
    assert {tuple(r) for r in op.compare_runs(plan, base, head, "m", "c", "v").collect()} == {(1, "preserved", 0), (2, "changed", 1), (3, "not_available", 0)}


def test_structural_diff_never_guesses(spark):
    cols = "id string, k string, c string"
    base = spark.createDataFrame([("b1", "same", "1"), ("b2", "mod", "1x"), ("b3", "gone", "moved"), ("b4", "dup", "d"), ("b5", "dup", "d"), ("b6", None, "n")], cols)
    head = spark.createDataFrame([("h1", "same", "1"), ("h2", "mod", "2x"), ("h3", "new", "moved"), ("h4", "dup", "d"), ("h6", None, "m")], cols)
    got = {tuple(r) for r in rows.structural_diff(base, head, "k", "c", "id").collect()}
    assert got == {("b1", "h1", "unchanged"), ("b2", "h2", "modified"), ("b3", "h3", "moved"), ("b4", None, "deleted"), ("b5", None, "deleted"), ("b6", None, "deleted"), (None, "h4", "added"), (None, "h6", "added")}


def test_changes_group_through_shared_keys(spark):
    units = spark.createDataFrame([(u, 10.0) for u in "abcdef"], "u string, size double")
    keys = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("b", "k2"), ("c", "k2"), ("d", "k3"), ("e", "k3")], "u string, key string")
    got = {r["u"]: (r["component"], r["chunk"]) for r in reports.group_changes(units, "u", keys, "size", 20).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 0), "c": ("a", 1), "d": ("d", 0), "e": ("d", 0), "f": ("f", 0)}
