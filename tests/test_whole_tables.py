"""Queries over whole tables against plain versions."""

from __future__ import annotations

import random

from conftest import SMALL
from strandline.operators import events
from strandline.plans import catalog


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)  # a root is the smallest id of its component
    return {x: root(x) for x in list(up)}


def test_components_equal_union_find(spark, duck):
    want = union_find(duck.execute("SELECT 2 * l_orderkey, 2 * l_partkey + 1 FROM lineitem").fetchall())
    got = {r["id"]: r["component"] for r in catalog.queries()["components"](spark, SMALL).collect()}
    assert got == want


def test_small_lines_and_events_link(spark, tmp_path):
    """Every line and event joins what it touches, whatever its quantity, flag or type."""
    d = str(tmp_path)
    put = lambda name, rows, cols: spark.createDataFrame(rows, cols).write.parquet(f"{d}/{name}.parquet")
    put("lineitem", [(1, 10, 1.0, "N"), (2, 10, 2.0, "A"), (2, 11, 50.0, "R"), (3, 12, 3.0, "N")], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string")
    put("orders", [(1, 7), (2, 8), (3, 9)], "o_orderkey long, o_custkey long")
    put("part", [(10, "Brand#1"), (11, "Brand#2"), (12, "Brand#2")], "p_partkey long, p_brand string")
    put("events", [(0, "view", 1.0, '{"k": 5}'), (5, "purchase", 2.0, '{"k": 6}'), (5, "error", 99.0, "{}")], "user_id long, event_type string, value double, props string")
    q = catalog.queries()
    assert {tuple(r) for r in q["components"](spark, d).collect()} == {(2, 2), (4, 2), (21, 2), (23, 2), (6, 6), (25, 6)}
    assert {r["id"] for r in q["dependency_closure"](spark, d).collect()} == {"p10", "o1", "o2", "c7", "c8"}
    assert {tuple(r) for r in q["callers_trace"](spark, d).collect()} == {(0, 0), (5, 1), (6, 2)}


def looped(sizes, limit):
    """The chunk of each row of one group, in order."""
    out, total, chunk = [], 0.0, 0
    for i, s in enumerate(sizes):
        if i and total + s > limit:
            chunk, total = chunk + 1, 0.0
        total += s
        out.append(chunk)
    return out


def test_range_chunks_follow_a_loop(spark):
    rng = random.Random(9)
    sizes = {"large": [rng.choice([0.0, 0.25, 1.0, 7.5, 30.0, 61.0, 150.0]) for _ in range(700)], "zero": [0.0] * 9, "one": [99.0], "exact": [30.0] * 8, "over": [100.0, 0.0, 0.0, 100.0, 60.0, 0.0, 0.5], "small": [5.0] * 3}
    rows = [(g, i, s) for g, all_ in sizes.items() for i, s in enumerate(all_)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, s double")
    got = {(r["g"], r["i"]): r["chunk"] for r in events.range_chunks(df, ["g"], ["i"], "s", 60).collect()}
    assert got == {(g, i): c for g, all_ in sizes.items() for i, c in enumerate(looped(all_, 60))}


def test_change_groups_equal_union_find_and_a_loop(spark, duck):
    lines = duck.execute("SELECT l_orderkey, -1 - l_partkey FROM lineitem").fetchall()
    found, groups = union_find(lines), {}
    for o in sorted({a for a, _ in lines}):
        groups.setdefault(found[o], []).append(o)
    want = {o: (min(g), c) for g in groups.values() for o, c in zip(g, looped([1.0] * len(g), 40))}
    assert len(want) > 1000 and max(c for _, c in want.values()) > 20
    assert {r["l_orderkey"]: (r["component"], r["chunk"]) for r in catalog.queries()["change_groups"](spark, SMALL).collect()} == want


def test_passages_need_every_word(spark, tmp_path):
    d, item = str(tmp_path), "one two three four five six seven eight nine ten eleven twelve thirteen at the x fourteen"
    texts = [(1, f"so {item} it goes"), (2, "one two three four five six seven eight nine ten eleven twelve and stop"), (3, "The one two three four five six seven, eight nine ten eleven the twelve thirteen fourteen"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7, item), (8, "of the"), (9, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert {tuple(r) for r in catalog.queries()["token_subsequence"](spark, d).collect()} == {(1, 7), (3, 7)}
