"""Every kind of coverage gap, ties, nulls and empty sides."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandline.functions import tables as written
from strandline.operators import coverage, graphs
from strandline.plans import catalog

E = "id string, kind string, evidence_ids array<string>, behavioral boolean, changed boolean"
L = "id string, from_id string, to_id string, relationship string, tier string, review_state string, evidence_ids array<string>"


def run(spark, entities, current=(), pending=(), stale=(), conflicts=(), candidates=(), reviewed=()):
    t = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    gaps, stats = coverage.matrix(t(entities, E), t(current, L), t(pending, L), t([(s,) for s in stale], "evidence_id string"), t(conflicts, "id string, from_id string, to_id string"), t(candidates, "id string, from_id string, to_id string, disposition string"), t(reviewed, "target_kind string, target_id string"))
    return {(r["kind"], r["subject_id"]) for r in gaps.collect()}, stats.first()


def test_gaps(spark):
    link = lambda i, a, b, rel, tier="A", review="accepted", ev=(): (i, a, b, rel, tier, review, list(ev))
    entities = [("r1", "requirement", None, None, None), ("r2", "requirement", [], False, False), ("w", "workflow", [], False, False), ("w2", "workflow", ["old"], False, False), ("s", "screen", [], False, False),
                ("f", "code-symbol", [], True, False), ("g", "code-symbol", [], True, None), ("h", "code-symbol", [], False, True), ("k", "code-symbol", [], True, True), ("e", "api-endpoint", [], False, False), ("e2", "api-endpoint", [], False, False)]
    current = [link("1", "r1", "w", "COVERED_BY"), link("2", "w", "s", "ON_SCREEN"), link("3", "s", "f", "BINDS", "C", "pending"), link("4", "e", "f", "HANDLED_BY"), link("5", "r2", "w2", "COVERED_BY", ev=["old"]), link("6", "w2", "g", "CALLS", "D"), link("7", "x", "g", "CHANGES")]
    pending = [link("3", "s", "f", "BINDS", "B", "not_required"), link("8", None, None, "CALLS")]
    got, stats = run(spark, entities, current, pending, ["old", None], [("c1", "r1", "w"), ("c2", "r1", "s")], [("q1", "r1", "w", None), ("q2", "r2", "w", "rejected"), ("q3", "r2", "s", "accepted")], [("conflict", "c2"), ("candidate", "q3"), ("candidate", "c1")])
    assert got == {
        ("requirement_without_workflow", "r2"), ("workflow_without_ui", "w2"), ("workflow_without_code", "w2"), ("endpoint_without_code", "e2"), ("code_without_intent", "g"), ("code_without_intent", "k"),
        ("changed_symbol_without_product_path", "g"), ("changed_symbol_without_product_path", "k"), ("conflict", "r1"), ("human_review_required", "r1"), ("stale_evidence", "w2"), ("stale_evidence", "r2"),
    }
    assert (stats["entities"], stats["requirements"], stats["workflows"], stats["api_endpoints"], stats["code_symbols"], stats["gaps"], stats["human_gaps"], stats["readiness"]) == (11, 2, 2, 2, 4, 11, 2, "needs_human")


def test_ready_and_empty(spark):
    got, stats = run(spark, [("r", "requirement", [], False, False)], [("1", "r", "w", "COVERED_BY", "A", "accepted", [])])
    assert got == set() and stats["readiness"] == "ready" and stats["confident_links"] == 1
    got, stats = run(spark, [], stale=["old"])
    assert got == {("stale_evidence", None)} and (stats["entities"], stats["gaps"], stats["readiness"]) == (0, 1, "needs_reconciliation")


def test_many_ids_in_small_files_are_not_broadcast(spark):
    """200,000 ids lie in a file that the planner would broadcast whole through the driver; here it is asked what it does with them."""
    seen, cut, before = [], coverage.cut, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    t = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    ids = spark.range(200_000).selectExpr("concat('w', id) as id", "'workflow' as kind", "cast(array() as array<string>) as evidence_ids", "false as behavioral", "false as changed")

    def watched(d, name):
        out = cut(d, name)
        if name == "entities":
            seen.append(out.join(out.selectExpr("id as i"), F.expr("id = i"))._jdf.queryExecution().sparkPlan().toString())
        return out

    coverage.cut = watched
    try:
        gaps, stats = coverage.matrix(ids, t([], L), t([], L), t([], "evidence_id string"), t([], "id string, from_id string, to_id string"), t([], "id string, from_id string, to_id string, disposition string"), t([], "target_kind string, target_id string"))
    finally:
        coverage.cut = cut
    assert seen and "BroadcastHashJoin" not in seen[0] and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert gaps.groupBy("kind").count().where("count = 200000").count() == 2 and stats.first()["gaps"] == 400_000


def tables(spark, d):
    """Lines of any quantity but one; o2 and what it touches rest on a returned line, c2 has only a pending order, n1 no handler."""
    put = lambda name, rows, cols: spark.createDataFrame(rows, cols).write.parquet(f"{d}/{name}.parquet")
    put("customer", [(1, 0, 10.0, "BUILDING"), (2, 1, -600.0, "MACHINERY")], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("orders", [(1, 1, "F", "5-LOW"), (2, 1, "P", "1-URGENT"), (3, 2, "O", "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    put("lineitem", [(1, 10, 1, 7.0, "N"), (2, 11, 2, 50.0, "R"), (3, 12, 2, 2.0, "A"), (3, 12, 2, 3.0, "N")], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string")
    put("supplier", [(1, 0, 5000.0), (2, 1, 10.0)], "s_suppkey long, s_nationkey int, s_acctbal double")
    put("part", [(1, 1), (10, 6), (11, 50), (12, 3)], "p_partkey long, p_size int")
    put("nation", [(0, 0), (1, 3)], "n_nationkey int, n_regionkey int")


def test_gap_rows_read_lines_of_every_quantity(spark, tmp_path):
    tables(spark, str(tmp_path))
    assert {tuple(r) for r in catalog.queries()["coverage_gap_rows"](spark, str(tmp_path)).collect()} == {
        ("requirement_without_workflow", "c2", None, False), ("workflow_without_ui", "o2", None, False), ("workflow_without_code", "o2", None, False), ("endpoint_without_code", "n1", None, False),
        ("code_without_intent", "p11", None, False), ("changed_symbol_without_product_path", "p11", None, False), ("conflict", "c2", "n1", True), ("human_review_required", "s1", "n0", True),
        *[("stale_evidence", i, None, False) for i in ("o2", "s2", "p11")],
    }


def test_matrix_stats_count_links_of_lines_of_every_quantity(spark, tmp_path):
    tables(spark, str(tmp_path))
    got = catalog.queries()["coverage_matrix_stats"](spark, str(tmp_path)).first().asDict()
    assert got == {"entities": 13, "requirements": 2, "workflows": 3, "api_endpoints": 2, "code_symbols": 4, "confident_links": 7, "gaps": 9, "human_gaps": 2, "readiness": "needs_human"}


def walked(edges, seeds, depths):
    """(id, k) of what search k reaches from its seeds, other ids than these."""
    out = set()
    for k, depth in enumerate(depths):
        known = {i for i, searches in seeds if searches >> k & 1}
        start, at = set(known), set(known)
        for _ in range(depth):
            at = {b for a, b, searches in edges if a in at and searches >> k & 1} - known
            known |= at
        out |= {(i, k) for i in known - start}
    return out


def test_searches_of_several_depths_equal_walks_by_themselves(spark, monkeypatch):
    rng, depths = random.Random(4), [1, 3, 8]
    edges = [(f"i{rng.randrange(150)}", f"i{rng.randrange(150)}", rng.randrange(8)) for _ in range(400)]
    seeds = [(f"i{rng.randrange(150)}", rng.randrange(8)) for _ in range(12)]
    want = walked(edges, seeds, depths)
    assert all(len([1 for _, k in want if k == j]) > 3 for j in range(3))
    e = spark.createDataFrame([*edges, ("i1", None, 7), (None, "i2", 7)], "src string, dst string, searches int")
    for most in (graphs.IDS_OF_A_BROADCAST, 0):  # levels given to every task, and dealt ones
        monkeypatch.setattr(graphs, "IDS_OF_A_BROADCAST", most)
        got = [(r["id"], k) for r in graphs.reached(e, spark.createDataFrame([*seeds, (None, 7)], "id string, searches int"), depths).collect() for k in range(3) if r["searches"] >> k & 1]
        assert len(got) == len(set(got)) and set(got) == want


def test_steps_of_the_matrix_go_once_they_are_read(spark, tmp_path, monkeypatch):
    """In many tasks and parts of links the gaps are the same, and of the written tables only those of the result and of levels stay."""
    tables(spark, str(tmp_path))
    names = lambda known: {p.rsplit("/", 1)[1][:4] for p in written._written if p not in known}
    known, few = set(written._written), sorted(map(str, catalog.queries()["coverage_gap_rows"](spark, str(tmp_path)).collect()))
    assert names(known) <= {"enti", "stal", "fron", "gaps"} and {"link", "conf", "ways", "mark"}.isdisjoint(names(known))
    let_go = []
    for module in (coverage, graphs, written):
        monkeypatch.setattr(module, "forget", let_go.append)
    monkeypatch.setattr(graphs, "EDGES_OF_A_TASK", 8)
    for most in (graphs.IDS_OF_A_BROADCAST, 0):
        monkeypatch.setattr(graphs, "IDS_OF_A_BROADCAST", most)
        assert sorted(map(str, catalog.queries()["coverage_gap_rows"](spark, str(tmp_path)).collect())) == few
    assert len(let_go) > 20


def test_current_links_of_several_tables_are_one(spark, monkeypatch):
    for module in (coverage, graphs, written):
        monkeypatch.setattr(module, "forget", lambda _: None)
    monkeypatch.setattr(graphs, "EDGES_OF_A_TASK", 4)
    t = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    a = [("1", "r1", "w", "COVERED_BY", "A", "accepted", []), ("2", "r2", "w", "COVERED_BY", "A", "accepted", ["old"]), ("3", "r3", "w", "COVERED_BY", "A", "accepted", [])]
    b = [("2", "r2", "x", "COVERED_BY", "A", "accepted", []), ("3", "r3", "x", "COVERED_BY", "A", "accepted", None), (None, "r4", "w", "COVERED_BY", "A", "accepted", [])]
    e = t([(f"r{k}", "requirement", [], False, False) for k in range(1, 6)], E)
    rest = t([("3", "r3", "w", "COVERED_BY", "D", "accepted", [])], L), t([("old",)], "evidence_id string"), t([], "id string, from_id string, to_id string"), t([], "id string, from_id string, to_id string, disposition string"), t([], "target_kind string, target_id string")
    for current in ([t(a, L), t(b, L)], t(a + b, L)):  # a link of stale evidence takes those of its id along, wherever they stand, and so does a pending one
        gaps, stats = coverage.matrix(e, current, *rest)
        assert sorted((r["kind"], r["subject_id"]) for r in gaps.collect()) == [("requirement_without_workflow", i) for i in ("r2", "r3", "r5")] + [("stale_evidence", i) for i in ("r2", "w")]
        assert stats.first()["confident_links"] == 2


def test_edges_are_dealt_once_and_joined_as_they_lie(spark):
    rows = [(f"i{k}", f"i{k * 7 % 50}", 1) for k in range(50)]
    parts = [spark.createDataFrame(rows[:30], "src string, dst string, searches int"), spark.createDataFrame(rows[30:], "src string, dst string, searches int")]
    dealt = written.deal(parts, "ways", 5, "src")
    at = spark.createDataFrame([(f"i{k}",) for k in range(0, 50, 3)], "src string")
    met = dealt.join(at.repartition(5, "src").hint("shuffle_hash"), "src")
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(tuple(r) for r in met.collect()) == sorted(rows[k] for k in range(0, 50, 3))
    name = written._catalogued[dealt._written]
    written.drop(dealt)
    assert dealt._written not in written._written and not spark.catalog.tableExists(name)
