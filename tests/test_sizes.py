"""Steps that must not put what grows with the tables into one task."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SMALL
from strandline.functions import text as tx
from strandline.functions import tables
from strandline.operators import events, graphs, linking, links, refresh, reports, rows as checks
from strandline.plans import citations, ingest, rules
from strandline.sources import diffs


def test_pairs_of_a_common_template_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(links, "IDS_OF_A_BLOCK", 4)
    monkeypatch.setattr(links, "PAIRS_OF_A_TASK", 64)
    paths = ["/{a}/b", "/{a}/b", "/x/b", "/x//b", "/x/c", "/", None]
    rows = [(k, "GET" if k % 5 else "PUT", paths[k % 3 if k % 2 else k % 7]) for k in range(120)] + [(7, "GET", "/{a}/b"), (None, "GET", "/x/b")]
    d = links.template_overlap(spark.createDataFrame(rows, "id long, method string, path string")).withColumn("task", F.spark_partition_id())
    got = [tuple(r) for r in d.collect()]
    cut = lambda p: [s for s in p.split("/") if s]
    fits = lambda p, q: len(cut(p)) == len(cut(q)) and all(x == y or "{" in x + y for x, y in zip(cut(p), cut(q), strict=True))
    known = [r for r in rows if None not in r]
    want = [(a, b, "exact" if p == q else "candidate") for a, m, p in known for b, n, q in known if a < b and m == n and fits(p, q)]
    assert sorted(r[:3] for r in got) == sorted(want)
    shares = [sum(r[3] == t for r in got) for t in {r[3] for r in got}]
    assert len(shares) > 10 and max(shares) < len(got) / 4


def test_components_deal_edges_to_tasks_by_number(spark, monkeypatch):
    monkeypatch.setattr(graphs, "EDGES_OF_A_TASK", 50)
    rows = [(1000 * c + i, 1000 * c + (i * 7 + 1) % 90) for c in range(20) for i in range(90)] + [(5, 5), (None, 3)]
    df = graphs.components(spark.createDataFrame(rows, "src long, dst long"))
    held = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    got = {r["id"]: r["component"] for r in df.collect()}
    parent = {v: v for r in rows if None not in r for v in r}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in rows:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {v: find(v) for v in parent}
    assert len(held) > 20 and max(held) < 200


def test_components_keep_the_tables_of_the_last_step_only(spark):
    known = set(tables._written)
    df = graphs.components(spark.createDataFrame([(i, i + 1) for i in range(0, 40)], "src long, dst long").repartition(9))
    assert len(set(tables._written) - known) == 1
    assert {(r["id"], r["component"]) for r in df.collect()} == {(i, 0) for i in range(41)}


def test_edges_of_a_task_are_merged_over_batches(monkeypatch):
    rnd = random.Random(2)
    edges = [(k % 50, rnd.randrange(50)) for k in range(900)] + [(100 + k, 101 + k) for k in range(300)]
    batch = lambda rows: pa.record_batch({"u": pa.array([a for a, _ in rows], pa.int64()), "v": pa.array([b for _, b in rows], pa.int64())})
    for most, share in ((1000, 360), (120, 700)):  # kept to the end, and given away where stars are many
        monkeypatch.setattr(graphs, "EDGES_OF_A_MERGE", most)
        got = [(a, b) for out in graphs._merge([batch(edges[i : i + 10]) for i in range(0, len(edges), 10)]) for a, b in zip(*(out.column(i).to_pylist() for i in (0, 1)))]
        assert len(got) < share
        roots = dict(zip(*(x.tolist() for x in graphs.stars(*np.array(got).T))))
        assert roots == {**{k: 0 for k in range(1, 50)}, **{k: 100 for k in range(101, 401)}}


def test_groups_of_changes_are_found_among_keys_and_let_go_of_steps(spark, monkeypatch):
    rnd = random.Random(6)
    pairs = [(u, rnd.randrange(90)) for u in range(100) for _ in range(u % 4)] + [(200, None), (201, None), (201, 500), (None, 1), (7, 7), (7, 7)]
    units = [(u, 1.0) for u in [*range(100), 200, 201, 300]]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, k in pairs:
        if u is not None and k is not None:
            up[root(u)] = root(-1 - k)
    members = {}
    for u, _ in units:
        members.setdefault(root(u), []).append(u)
    want = {u: (min(m), i // 3) for m in members.values() for i, u in enumerate(sorted(m))}
    known, asked, find = set(tables._written), [], graphs.components
    monkeypatch.setattr(graphs, "components", lambda e: asked.append(e.count()) or find(e))
    for kind in ("long", "string"):
        keys = spark.createDataFrame([(u, k if kind == "long" or k is None else f"k{k}") for u, k in pairs], f"unit long, key {kind}")
        df = reports.group_changes(spark.createDataFrame(units, "unit long, size double"), "unit", keys, "size", 3)
        assert {r["unit"]: (r["component"], r["chunk"]) for r in df.collect()} == want
    real = {(u, k) for u, k in pairs if u is not None and k is not None}
    assert max(asked) <= len([p for p in pairs if None not in p]) - len({u for u, _ in real})  # a unit is no node, its least key no edge
    assert len(set(tables._written) - known) <= 2 * 2  # the groups and which of them are large
    monkeypatch.setattr(graphs, "EDGES_OF_A_TASK", 20)
    let_go = []
    monkeypatch.setattr(reports, "forget", let_go.append)
    monkeypatch.setattr(graphs, "forget", let_go.append)
    assert {r["unit"]: (r["component"], r["chunk"]) for r in reports.group_changes(spark.createDataFrame(units, "unit long, size double"), "unit", keys, "size", 3).collect()} == want
    assert len(let_go) > 5


def test_edges_meet_claims_at_their_rarest_evidence_only(spark, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(links, "cut", lambda d, name: d)
    edges = [(i, [0, 1, rnd.randrange(2, 60)] if i % 3 else [0, 0, 1]) for i in range(60)] + [(100, [0, 999]), (101, []), (102, None), (103, [0, None])]
    claims = [(c, [0, 1] + [rnd.randrange(2, 60) for _ in range(c % 9)] + ([None] if c % 4 else [])) for c in range(80)] + [(200, None), (201, [])]
    df = links.backed_edges(spark.createDataFrame(edges, "id long, evidence_ids array<long>"), spark.createDataFrame(claims, "claim_id long, evidence_ids array<long>"))
    got = sorted((r["id"], r["claim_id"]) for r in df.collect())
    assert got == sorted((i, c) for i, e in edges for c, h in claims if e and h and None not in e and set(e) <= set(h))
    above = df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in above  # pairs of edges and claims are not grouped


def test_first_customers_are_found_without_pairing_all(spark):
    s, c = [(k, n) for n in range(4) for k in range(30)] + [(3, None)], [(k, k % 3) for k in range(0, 200, 7)] + [(50, None)]
    df = ingest._first_above(spark.createDataFrame(s, "s_suppkey long, s_nationkey int"), spark.createDataFrame(c, "c_custkey long, c_nationkey int"))
    got = {(r["s_nationkey"], r["s_suppkey"]): r["k"] for r in df.collect()}
    assert got == {(n, k): min((x for x, m in c if n is not None and m == n and x > 9 * k), default=None) for k, n in s}
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_patches_are_dealt_to_tasks_and_sorted_once(spark, monkeypatch):
    monkeypatch.setattr(diffs, "CHARS_OF_A_TASK", 2000)
    hunk = "@@ -{0},2 +{1} @@ f()\n a\n-b\n+c\n+diff --git\n\\ No newline\n"
    files = ["diff --git a/{2} b/{2}\n--- a/{2}\n+++ b/{2}\n" + hunk + hunk, "diff --git a/{2} b/{2}\nrename from {2}\nrename to z\n", "-stray\n" + hunk]
    patches = [(k, "".join(files[(k + i) % 3].format(7 * i + 1, 9 * i + 4, f"f{i}") for i in range(k % 5))) for k in range(200)] + [(500, None)]
    want = []
    for k, text in patches:
        file = open_ = base = head = 0
        for row in (text or "").split("\n"):
            if row.startswith("diff --git "):
                file, open_ = file + 1, False
            elif row.startswith("@@ -"):
                open_, (base, head) = True, (int(x.split(",")[0][1:]) - 1 for x in row.split(" ")[1:3])
            elif open_ and row[:1] in (" ", "+", "-"):
                base, head = base + (row[0] != "+"), head + (row[0] != "-")
                if row[0] != " ":
                    want.append((k, file, "base" if row[0] == "-" else "head", base if row[0] == "-" else head, row[1:]))
    df = diffs.diff_lines(spark.createDataFrame(patches, "pr_id long, patch string"))
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    shares = [sum(r["task"] == t for r in rows) for t in {r["task"] for r in rows}]
    assert len(shares) > 10 and max(shares) < len(rows) / 4
    assert df._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    lines = [r for r in diffs.diff_files(spark.createDataFrame(patches, "pr_id long, patch string")).collect()]
    assert len(lines) == sum((t or "").count("diff --git a/") for _, t in patches)


def test_chunks_move_rows_of_small_groups_once_and_cut_large_ones_by_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    sized = [(g, i, rnd.choice([0.0, 0.1, 7.25, 20.0, 59.9, 60.0, 75.0])) for g in range(12) for i in range(40 * (g % 4) + 1)]
    want = {}
    for g in range(12):
        used, chunk = 0, 0
        for _, i, s in sorted(r for r in sized if r[0] == g):
            n = round(s * 100)
            used, chunk = (used + n, chunk) if used + n <= 6000 or i == 0 else (n, chunk + 1)
            want[g, i] = chunk
    rnd.shuffle(sized)
    x = spark.createDataFrame(sized, "g long, i long, s double")
    once = events.range_chunks(x, ["g"], ["i"], "s", 60)
    assert {(r["g"], r["i"]): r["chunk"] for r in once.collect()} == want
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Join" not in plan and "Window" not in plan
    cut, blocks = [], events._block_chunks
    monkeypatch.setattr(events, "ROWS_OF_A_FOLD", 80)
    monkeypatch.setattr(events, "_block_chunks", lambda d, *a: cut.extend(r["g"] for r in d.select("g").distinct().collect()) or blocks(d, *a))
    assert {(r["g"], r["i"]): r["chunk"] for r in events.range_chunks(x, ["g"], ["i"], "s", 60).collect()} == want
    assert sorted(cut) == [2, 3, 6, 7, 10, 11]


def test_claims_of_one_evidence_are_not_grouped(spark):
    bound = [("s", "A", "p"), (None, "A", "p")]
    ev = [(f"e{k}", "app", "captured", f"m{k % 3}" if k % 4 else None, "x", f"r{k % 2}", f"h{k}" if k % 2 else None, None, k, bound if k % 5 else None, "bad" if k == 7 else None) for k in range(8)]
    kinds = "evidence_id string, application_id string, status string, method string, source_kind string, run_id string, commit_sha string, artifact_id string, captured_at int, bindings array<struct<from_id:string,relationship:string,to_id:string>>, code string"
    lists = [None, [], [None], ["e1"], ["e0"], ["e4"], ["e7"], ["gone"], ["e2", "e1"], ["e1", "e7", "gone"], ["e1", None], ["e1", "e1"], ["e5", "e2", "e1"], ["e0", "e3"]]
    claims = [(f"{i}-{f}-{sub}", "app", f, "A", "p", "supports", "why", sub, x) for i, x in enumerate(lists) for f in ("s", "t", None) for sub in (True, False)]
    c = spark.createDataFrame(claims, "claim_id string, application_id string, from_id string, relationship string, to_id string, assertion string, explanation string, submitted boolean, evidence_ids array<string>")
    policy = spark.createDataFrame([("A", "seen", m, "B") for m in ("m1", "m2")], "relationship string, clause string, method string, tier string")
    df = linking.validated(c, spark.createDataFrame(ev, kinds), policy, "app")
    known, want = {e[0]: e for e in ev}, {}
    for cid, _, f, rel, to, _, _, sub, ids in claims:
        cited = [(i, known.get(i)) for i in ids or []]
        bad = [("missing_evidence" if e is None else e[10]) for _, e in cited if e is None or e[10]]
        methods = sorted({e[3] for _, e in cited if e and e[3]})
        tied = all(e and f and e[9] and (f, rel, to) in e[9] for _, e in cited)
        code = bad[0] if bad else "unsupported_relationship_evidence" if set(methods) - {"m1", "m2"} else "required_evidence_missing" if not methods else "evidence_binding_mismatch" if sub and not tied else None
        want[cid] = (code, sorted({i for i, _ in cited if i}), methods, max((e[8] for _, e in cited if e), default=None))
    got = {r["claim_id"]: (r["code"], r["evidence_ids"] or [], r["methods"] or [], r["captured_at"]) for r in df.collect()}
    assert got == want
    assert "Union" in df._jdf.queryExecution().optimizedPlan().toString()  # one side is the join alone


def test_integrity_checks_deal_rows_to_tasks_by_number(spark, monkeypatch):
    monkeypatch.setattr(checks, "ROWS_OF_A_TASK", 100)
    rows = [(k % 1900, k % 3) for k in range(3800)] + [(None, 1), (None, 1), (7, None)]
    df, parent = spark.createDataFrame(rows, "a long, b long"), spark.createDataFrame([(k,) for k in range(0, 4000, 2)] * 2 + [(None,)], "k long")
    for d, want in (
        (checks.duplicates(df, ["a", "b"]), [r for r in set(rows) if rows.count(r) > 1]),
        (checks.duplicates(df, ["a"]), [(a,) for a in {r[0] for r in rows}]),
        (checks.orphans(df, "a", parent, "k"), [(a,) for a, _ in rows if a is not None and a % 2]),
    ):
        got = [tuple(r) for r in d.withColumn("task", F.spark_partition_id()).collect()]
        assert sorted(map(str, (r[:-1] for r in got))) == sorted(map(str, want))
        shares = [sum(r[-1] == t for r in got) for t in {r[-1] for r in got}]
        assert len(want) < 10 or (len(shares) > 10 and max(shares) < len(got) / 4)
        assert "Sort" not in d._jdf.queryExecution().executedPlan().toString()


def test_publication_joins_edges_once_in_tasks_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(checks, "ROWS_OF_A_TASK", 200)
    kept, write = [], rules.cut
    monkeypatch.setattr(rules, "cut", lambda d, name: kept.append([r["n"] for r in d.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]) or write(d, name))
    df = rules.publication_validation(spark, SMALL)
    assert len(kept) == 1 and len(kept[0]) > 10 and max(kept[0]) < sum(kept[0]) / 4
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.count("RepartitionByExpression [code") == 1
    assert {r["code"] for r in df.collect()} >= {"missing_from", "unreviewed_tier"}


def test_claims_are_dealt_to_tasks_and_their_texts_read_once(spark, monkeypatch):
    monkeypatch.setattr(citations, "CLAIMS_OF_A_TASK", 5)
    df = citations.claim_objections(spark, SMALL)
    held = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(held) > 10 and max(held) < sum(held) / 4
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(?<![a-z0-9])") == 5  # kept words of five texts


def test_kept_words_equal_plain_python(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["a", "an", "And", "x1", "TO", "to", "the", "then", "9", "é", "İ", " ", " ", "-", "\n", "order"]) for _ in range(rnd.randrange(14))) for _ in range(400)] + [None, ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.kept_words(F.col("t")).alias("w"), tx.supports(F.col("t"), F.lit("then the order")).alias("s"))
    for r in got.collect():
        t = texts[r["i"]]
        want = None if t is None else [w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 1 and w not in tx.SUPPORT_STOP_WORDS]
        assert r["w"] == want and r["s"] == (None if t is None else any(want[k : k + 2] == ["then", "order"] for k in range(len(want))))


def test_refresh_sorts_no_table_and_deals_entities_and_links_by_number(spark, monkeypatch):
    monkeypatch.setattr(refresh, "cut", lambda d, name: d)
    monkeypatch.setattr(graphs, "cut", lambda d, name: d)
    ents = [(f"f{k}", "file", [f"src/{k % 2}/{k}"], [], k % 90 == 1) for k in range(600)] + [(f"w{k}", "workflow", None, [f"f{k}", f"w{k - 1}"], False) for k in range(600)] + [(f"r{k}", "requirement", [], [f"w{k}"] if k % 50 == 0 else None, None) for k in range(600)]
    ties = [(f"l{k}", f"r{k}", f"w{k}", "COVERED_BY" if k % 3 else "SEES", "accepted" if k % 2 else "open", ["docs/a" if k % 4 else "docs/b"]) for k in range(600)] + [("ln", None, None, "COVERED_BY", None, None)]
    e = spark.createDataFrame(ents, "id string, kind string, source_paths array<string>, depends_on_ids array<string>, stale boolean")
    li = spark.createDataFrame(ties, "id string, from_id string, to_id string, relationship string, review_state string, source_paths array<string>")
    c = spark.createDataFrame([("src/0/8",), ("src/0/500",), ("docs/b",), (None,)], "path string")
    monkeypatch.setattr(refresh, "affected", lambda *_: spark.createDataFrame([(f"w{k}", k % 7, "stale", None) for k in range(0, 600, 5)] + [(f"r{k}", 1, "stale", None) for k in range(0, 600, 9)], "id string, hop int, reason string, via string"))
    once = sorted(map(str, refresh.plan(e, li, c).collect()))
    monkeypatch.setattr(checks, "ROWS_OF_A_TASK", 50)
    df = refresh.plan(e, li, c)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan
    got = [tuple(r) for r in df.withColumn("task", F.spark_partition_id()).collect()]
    assert sorted(map(str, df.collect())) == once
    assert len({r[-1] for r in got}) > 40 and max(sum(r[-1] == t for r in got) for t in {r[-1] for r in got}) < 100
    monkeypatch.setattr(refresh, "PATHS_OF_A_BROADCAST", 0)
    assert sorted(map(str, refresh.plan(e, li, c).collect())) == once
    assert "Sort" not in refresh.touched(li, c)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.undo()
    few = sorted(map(str, graphs.closure_with_reasons(*_closure(spark)).collect()))
    monkeypatch.setattr(graphs, "IDS_OF_A_BROADCAST", 0)
    monkeypatch.setattr(graphs, "EDGES_OF_A_TASK", 50)
    assert sorted(map(str, graphs.closure_with_reasons(*_closure(spark)).collect())) == few and len(few) == 301  # 300 ids and the null one


def _closure(spark):
    edges = [(k, k // 4, f"y{k % 3}") for k in range(1, 300)] + [(5, 7, "x"), (1, 299, "z"), (None, 2, "n")]
    return spark.createDataFrame(edges, "id int, on_id int, reason string"), spark.createDataFrame([(0, "s"), (None, "s")], "id int, reason string")
