"""Operators on hand-made tables: edge cases, ambiguity, and versions in plain Python."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from strandline.functions import rules as labels
from strandline.functions import text as tx
from strandline.operators import events, graphs, impact, links, publish, rows, rules, summaries, texts
from strandline.sources import api_documents, diffs, html
from strandline.streaming import event_log


def test_greedy_chunks_and_admission_follow_a_loop(spark):
    rng = random.Random(5)
    data = [(g, i, float(rng.randint(1, 60))) for g in range(20) for i in range(rng.randint(1, 15))]
    df = spark.createDataFrame(data, "g int, i int, s double")
    chunks, admitted = {}, {}
    for g in range(20):
        total, chunk, first, room = 0.0, 0, True, 0.0
        for _, i, s in sorted(x for x in data if x[0] == g):
            if not first and total + s > 60:
                chunk, total = chunk + 1, 0.0
            total, first = total + s, False
            chunks[g, i] = chunk
            admitted[g, i] = room + s <= 100
            room += s if admitted[g, i] else 0
    assert {(r["g"], r["i"]): r["chunk"] for r in events.range_chunks(df, ["g"], ["i"], "s", 60).collect()} == chunks
    assert {(r["g"], r["i"]): r["admitted"] for r in events.admit_within(df, ["g"], ["i"], "s", 100).collect()} == admitted


def test_ranges_touch_overlap_and_nest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 8), ("a", 2, 3), ("a", 10, 12), ("b", 1, 1)], "g string, s int, e int")
    got = {tuple(r) for r in events.merge_ranges(df, ["g"], "s", "e").select("g", "s", "e", "members").collect()}
    assert got == {("a", 1, 8, 3), ("a", 10, 12, 1), ("b", 1, 1, 1)}


def test_innermost_tie_is_ambiguous(spark):
    iv = spark.createDataFrame([("f", 0, 100, "outer"), ("f", 10, 20, "x"), ("f", 10, 20, "y"), ("f", 50, 55, "z")], "f string, s int, e int, name string")
    pts = spark.createDataFrame([("f", 15), ("f", 52), ("f", 70), ("f", 500), ("other", 15)], "f string, at int")
    got = {(r["f"], r["at"]): (r["outcome"], r["name"]) for r in rows.innermost(pts, iv, ["f"], "at", "s", "e", "name", ["f", "at"], 16).collect()}
    assert got == {("f", 15): ("ambiguous", None), ("f", 52): ("matched", "z"), ("f", 70): ("matched", "outer"), ("f", 500): ("unmatched", None), ("other", 15): ("unmatched", None)}


def test_nearest_ranks_equal_sorting(spark):
    rng = random.Random(1)
    data = [(g, rng.choice([rng.random(), 3.0])) for g in ("a", "b") for _ in range(rng.randint(30, 200))] + [("one", 7.0), ("null", None)]
    got = {r["g"]: (r["p50"], r["p95"]) for r in summaries.nearest_ranks(spark.createDataFrame(data, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}, buckets=8).collect()}
    for g in ("a", "b", "one"):
        s = sorted(v for k, v in data if k == g)
        at = lambda q: s[max(0, -(-int(q * 100) * len(s) // 100) - 1)]
        assert got[g] == (at(0.5), at(0.95))
    assert "null" not in got


@pytest.mark.parametrize(("tp", "fp", "fn", "want"), [(0, 0, 0, (1, 1, 1)), (0, 0, 3, (0, 0, 0)), (0, 2, 0, (0, 1, 0)), (2, 1, 1, (2 / 3, 2 / 3, 2 / 3))])
def test_ratios_of_empty_sets(spark, tp, fp, fn, want):
    r = summaries.ratios(spark.createDataFrame([(tp, fp, fn)], "tp long, fp long, fn long")).first()
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(want)


def test_graph_searches_follow_plain_python(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)})
    e = spark.createDataFrame(edges, "src long, dst long")
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    for seed in (0, 5):
        dist, level = {seed: 0}, {seed}
        for d in range(1, 5):
            level = {b for a in level for b in near.get(a, ())} - set(dist)
            dist |= {x: d for x in level}
        got = graphs.distances(e, spark.createDataFrame([(seed, seed)], "seed long, id long"), 4).collect()
        assert {r["id"]: r["dist"] for r in got} == dist
        paths = [[seed]]
        want = set()
        for d in range(1, 5):
            paths = [p + [b] for p in paths for b in near.get(p[-1], ()) if dist.get(b) == d]
            want |= {tuple(p) for p in paths}
        ids = spark.range(40)
        got = graphs.shortest_paths(e, spark.createDataFrame([(seed,)], "id long"), ids, 4).collect()
        assert {tuple(r["nodes"]) for r in got} == want
    comp = {x: x for p in edges for x in p}
    for _ in range(40):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r["id"]: r["component"] for r in graphs.components(e).collect()} == {k: v for k, v in comp.items() if k not in loops}


def test_trails_may_repeat_nodes_but_not_edges(spark):
    e = spark.createDataFrame([(1, 0, 1), (2, 1, 2), (3, 2, 0), (4, 0, 3)], "edge_id int, src int, dst int")
    got = {tuple(r["edges"]) for r in graphs.trails(e, spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(3,)], "id int"), 5).collect()}
    assert got == {(1, 4), (2, 3, 4)}


def test_lineage_stops_at_depth_and_at_missing_parents(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(30)] + [(100, 999)], "id long, parent long")
    got = {r["id"]: (r["root"], r["hops"]) for r in graphs.lineage(df, "id", "parent", 20).collect()}
    assert got == {i: (max(0, i - 20), min(i, 20)) for i in range(30)} | {100: (100, 0)}


def _candidate(cid, tier="A", review="accepted", stale=False, app="app", evidence=("e1",), conflict=(), hop_type="COVERED_BY", operation="modified"):
    node = lambda i, k: (i, k, "A", "accepted", app, 1)
    hops = [("HAS_STEP", "w", "f", tier, review, app, 1, stale, list(evidence), list(conflict)), (hop_type, "r", "w", "A", "accepted", app, 1, False, ["e9"], [])]
    return (cid, "f", "r", "requirement", "R", operation, [node("f", "flow-step"), node("w", "workflow"), node("r", "requirement")], hops)


_NODE = "array<struct<id:string,kind:string,tier:string,review:string,application_id:string,revision:int>>"
_HOP = "array<struct<type:string,from_id:string,to_id:string,tier:string,review:string,application_id:string,revision:int,stale:boolean,evidence_ids:array<string>,conflict_ids:array<string>>>"
_CANDIDATE = f"candidate_id string, seed_id string, target_id string, target_kind string, title string, operation string, nodes {_NODE}, hops {_HOP}"


def test_caveats_name_every_reason(spark):
    df = spark.createDataFrame(
        [_candidate("ok"), _candidate("d", tier="D"), _candidate("c", tier="C", review="pending"), _candidate("s", stale=True), _candidate("a", app="other"), _candidate("x", conflict=("k",)), _candidate("t", hop_type="BINDS")], _CANDIDATE
    )
    got = {r["candidate_id"]: r["codes"] for r in impact.caveats(df, "app", 1).collect()}
    assert got == {"ok": [], "d": ["tier_d_evidence"], "c": ["review_unresolved"], "s": ["stale_revision"], "a": ["foreign_application"], "x": ["evidence_conflict"], "t": ["invalid_direction"]}


def test_corroborated_finding_scores(spark):
    df = spark.createDataFrame([_candidate("1", evidence=("e1", "e2")), _candidate("2", tier="B", evidence=("e3",), operation="deleted")], _CANDIDATE)
    paths = impact.merged_paths(impact.caveats(df, "app", 1).where("size(codes) = 0"))
    r = impact.findings(paths, spark.createDataFrame([("r", "critical")], "target_id string, criticality string")).collect()
    assert len(r) == 1 and (r[0]["change"], r[0]["criticality_points"], r[0]["directness"], r[0]["breadth"], r[0]["shared"], r[0]["corroboration"]) == (3, 4, 3, 1, 0, 1)
    assert (r[0]["score"], r[0]["risk"], r[0]["strength"]) == (12, "high", "A")


def test_publish_is_idempotent_copies_on_write_and_rejects(spark, tmp_path):
    root = f"file://{tmp_path}/graph"
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("e1", "a", "b", "A", "accepted"), ("e2", "b", "c", "A", "accepted")], "id string, from_id string, to_id string, tier string, review_state string")
    assert publish.publish(spark, root, nodes, edges) == 1
    assert publish.publish(spark, root, nodes.orderBy(F.desc("id")), edges) == 1
    assert publish.publish(spark, root, spark.createDataFrame([("c",), ("d",)], "id string"), edges.limit(0), spark.createDataFrame([("c",)], "id string")) == 2
    assert {r["id"] for r in publish.read(spark, root, "nodes").collect()} == {"a", "b", "c", "d"}
    assert {r["id"] for r in publish.read(spark, root, "edges").collect()} == {"e1"}
    with pytest.raises(publish.InvalidPublication, match="missing_to"):
        publish.publish(spark, root, nodes, spark.createDataFrame([("e3", "a", "zz", "A", "accepted")], edges.schema))
    assert publish.current(spark, root) == 2


def test_policy_needs_a_method_for_every_clause(spark):
    links = spark.createDataFrame([(1, "R"), (2, "R"), (3, "none")], "link int, relation string")
    methods = spark.createDataFrame([(1, "m1"), (1, "m3"), (2, "m1")], "link int, method string")
    policy = spark.createDataFrame([("R", "a", "m1"), ("R", "a", "m2"), ("R", "b", "m3")], "relation string, clause string, method string")
    assert {tuple(r) for r in rules.policy_met(links, methods, policy, "link", "relation").collect()} == {(1, True), (2, False), (3, True)}


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://X.org//a//b?b=2&utm_source=z&a=1#top", "http://x.org/a/b?a=1&b=2"), ("https://x.org", "https://x.org/"), ("https://x.org/?gclid=1", "https://x.org/"), (None, None)],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(tx.canonical_url(F.col("u"))).first()[0] == want


@pytest.mark.parametrize(
    ("path", "want"), [("/api/v1/users/{id}/", "/users/{param}"), ("users/:id/posts/[post]", "/users/{param}/posts/{param}"), ("/api/v1", "/"), ("/api/v1x/a?q=1", "/v1x/a"), ("", "/")]
)
def test_endpoint_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(tx.endpoint_path(F.col("p"), ("/api", "/api/v1"))).first()[0] == want


def test_redaction(spark):
    text = "token: abc\nkeep this\nghp_" + "a" * 24 + " end\nCookie: x=1\n-----BEGIN RSA PRIVATE KEY-----\nzzz"
    got = spark.createDataFrame([(text,)], "t string").select(tx.redact(F.col("t"))).first()[0]
    assert got == "token: [REDACTED]\nkeep this\n[REDACTED] end\nCookie: [REDACTED]\n[REDACTED]"


def test_similar_names_lose_no_pair(spark):
    rng = random.Random(2)
    words = ["red", "blue", "bolt", "bolts", "gear", "widget", "wedge", "ring"]
    names = [" ".join(rng.sample(words, 2)) for _ in range(60)]
    grams = lambda s: {f"  {s}  "[i : i + 3] for i in range(len(s) + 2)}
    norm = lambda s: s[:-1] if len(s) > 3 and s.endswith("s") else s
    u = sorted(set(names))
    want = {(a, b) for a in u for b in u if a < b and 2 * len(grams(norm(a)) & grams(norm(b))) / (len(grams(norm(a))) + len(grams(norm(b)))) >= 0.6}
    got = texts.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), "name", 0.6).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_sections_of_a_page(spark):
    page = "<html><head><title>T</title><style>x{}</style></head><body><nav><h1>No</h1>menu</nav><main><h1>Guide</h1><p>Start  here.</p><h2>Setup</h2><p>Do &amp; run.</p><script>var a;</script><h2>Use</h2>Go.</main></body></html>"
    got = html.sections(spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string"), "id", "html").collect()
    assert [(r["heading_path"], r["excerpt"], r["start"], r["end"]) for r in got] == [(["Guide"], "Start here.", 0, 11), (["Guide", "Setup"], "Do & run.", 13, 22), (["Guide", "Use"], "Go.", 24, 27)]


def test_sections_of_markdown(spark):
    text = "intro\n# A\none\n```\n# no heading\n```\n## B\ntwo\n# C"
    got = html.markdown_sections(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()
    assert [(r["heading_path"], r["excerpt"]) for r in got] == [([], "intro"), (["A"], "one ``` # no heading ```"), (["A", "B"], "two")]
    assert list(html.split_section("a" * 10, 4)) == ["aaaa", "aaaa", "aa"] and list(html.split_section("ab cd ef", 6)) == ["ab cd", "ef"]


PATCH = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -1,4 +1,5 @@ def f
 keep
-old
+new
+more
 keep
 keep
@@ -10,2 +11,1 @@
 keep
-gone
diff --git a/old.ts b/dir/new.ts
similarity index 90%
rename from old.ts
rename to dir/new.ts
diff --git a/n.md b/n.md
new file mode 100644
--- /dev/null
+++ b/n.md
@@ -0,0 +1,2 @@
+one
+two"""


def test_git_diff(spark):
    df = spark.createDataFrame([("p", PATCH)], "pr_id string, patch string")
    files = {r["file"]: (r["operation"], r["old_path"], r["new_path"], r["similarity"]) for r in diffs.diff_files(df).collect()}
    assert files == {1: ("modified", "x.py", "x.py", None), 2: ("renamed", "old.ts", "dir/new.ts", 90), 3: ("added", None, "n.md", None)}
    lines = {(r["file"], r["side"], r["line"], r["content"]) for r in diffs.diff_lines(df).collect()}
    assert lines == {(1, "base", 2, "old"), (1, "head", 2, "new"), (1, "head", 3, "more"), (1, "base", 11, "gone"), (3, "head", 1, "one"), (3, "head", 2, "two")}
    ranges = {(r["file"], r["side"], r["first"], r["last"]) for r in diffs.diff_ranges(diffs.diff_lines(df)).collect()}
    assert ranges == {(1, "base", 2, 2), (1, "head", 2, 3), (1, "base", 11, 11), (3, "head", 1, 2)}


def test_openapi_and_webhooks(spark):
    doc = '{"servers":[{"url":"https://h/api/"}],"paths":{"/users/{id}":{"get":{"operationId":"u","tags":["a","b"]},"parameters":[]},"/x":{"post":{}}}}'
    got = {(r["method"], r["path"], r["operation_id"], tuple(r["tags"])) for r in api_documents.endpoints(spark.createDataFrame([("app", doc)], "application_id string, document string")).collect()}
    assert got == {("GET", "/api/users/{param}", "u", ("a", "b")), ("POST", "/api/x", None, ())}
    sha = "a" * 40
    body = f'{{"action":"opened","pull_request":{{"number":7,"draft":false,"head":{{"sha":"{sha}"}}}}}}'
    rows_ = [("1", "pull_request", body), ("2", "ping", "{}"), ("3", "pull_request", body.replace("opened", "closed")), ("4", "pull_request", body.replace(sha, "zz")), ("5", "push", "{}")]
    got = {r["delivery_id"]: r["decision"] for r in api_documents.decisions(spark.createDataFrame(rows_, "delivery_id string, event string, payload string")).collect()}
    assert got == {"1": "accepted", "2": "ignored_ping", "3": "ignored_action", "4": "malformed", "5": "ignored_event"}


def test_stream_faults_equal_batch(spark, tmp_path):
    data = [(c, t, "user" if t % 2 else "assistant") for c in range(8) for t in range(6) if (c + t) % 5] + [(1, 2, "system")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string")
    df.repartition(3).write.parquet(str(tmp_path / "log.parquet"))
    got = event_log.sequence_faults(spark, f"file://{tmp_path}/log.parquet", df.schema, "conv_id", "turn", "role")
    want = events.feed_faults(df, "conv_id", "turn", F.col("role"))
    key = lambda d, f: sorted((r["conv_id"], r["turn"]) for r in d.where(F.col("fault") == f).collect())
    assert key(got, "gap") == key(want, "gap") and key(got, "conflict") == key(want, "conflict")


def test_sequence_faults_over_batches_and_many_keys(spark, tmp_path):
    """Three batches against a plain loop; then many keys, none of which may cost a call of its own."""
    rng = random.Random(12)
    batches = [[(rng.choice(["a", "b", None]), rng.choice([None, *range(9)]), rng.choice("xy")) for _ in range(12)] for _ in range(3)]
    seen, tops, want = {}, {}, []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "k string, n int, c string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        for k, n, c in sorted((r for r in batch if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
            if (k, n) in seen:
                want.append((k, n, "replay" if seen[k, n] == c else "conflict"))
                continue
            if k in tops and n > tops[k] + 1:
                want.append((k, n, "gap"))
            seen[k, n], tops[k] = c, max(n, tops.get(k, n))
        time.sleep(1.1)  # files are taken by their time
    schema = spark.read.parquet(f"{tmp_path}/log").schema
    got = event_log.sequence_faults(spark, f"file://{tmp_path}/log", schema, "k", "n", "c", files_per_batch=1)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))

    many = spark.range(200_000).selectExpr("id div 2 as k", "cast(id % 2 * 2 as int) as n", "'x' as c")
    many.coalesce(1).write.parquet(f"{tmp_path}/many")
    began = time.time()
    got = event_log.sequence_faults(spark, f"file://{tmp_path}/many", many.schema, "k", "n", "c")
    assert got.groupBy("fault").count().collect() == [("gap", 100_000)] and time.time() - began < 40


def test_small_tables_are_read(spark):
    assert spark.read.parquet(f"{SMALL}/region.parquet").count() == 5


def test_page_owners_follow_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, f"u{rng.randrange(40)}", f"h{rng.randrange(40)}") for i in range(120)]
    uris, hashes, want = set(), set(), []
    for i, u, h in rows:
        if u not in uris and h not in hashes:
            uris.add(u)
            hashes.add(h)
            want.append(i)
    got = links.first_owners(spark.createDataFrame(rows, "id long, uri string, content string"), "id", ["uri", "content"])
    assert sorted(r["id"] for r in got.collect()) == want
    assert links.first_owners(spark.createDataFrame([], "id long, uri string"), "id", ["uri"]).count() == 0


def test_latest_descendants_leave_out_cycles(spark):
    rows = [(1, None, 1), (2, 1, 2), (3, 2, 9), (4, 2, 5), (5, 77, 3), (6, 7, 1), (7, 6, 1)]
    got = links.latest_descendants(spark.createDataFrame(rows, "id long, parent long, at long"), "id", "parent", "at").collect()
    assert {(r["root"], r["latest"]) for r in got} == {(1, 3), (5, 5)}


def test_search_and_paths_filter_before_they_look(spark):
    nodes = spark.createDataFrame([("a", "x", "Big BOLT"), ("b", "y", "bolt"), ("c", "x", "nut")], "id string, kind string, title string")
    assert [r["id"] for r in links.search(nodes, "Bolt").collect()] == ["a", "b"]
    assert [r["id"] for r in links.search(nodes, "bolt", ["y"], 1).collect()] == ["b"] and links.search(nodes, "bolt", []).count() == 0
    edges = spark.createDataFrame([(1, "a", "b", "T", "A", "accepted"), (2, "b", "c", "T", "D", "accepted"), (3, "a", "c", "U", "A", "pending")], "edge_id int, src string, dst string, type string, tier string, review_state string")
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    assert links.evidence_paths(edges, one("a"), one("c"), 4, types=["T"], tiers=["A"]).count() == 0
    assert [r["edges"] for r in links.evidence_paths(edges, one("a"), one("c"), 4).collect()] == [[3], [1, 2]]


def test_observed_text_loses_what_identifies(spark):
    said = [("mail me at a.b@c.org now", "mail me at [EMAIL_REDACTED] now"), ("card 4111 1111 1111 1111 ok", "card [PAYMENT_REDACTED] ok"), ("call +49 (30) 1234-5678.", "call [PHONE_REDACTED]."), (" \n\t ", "[EMPTY]"), ("x" * 30, "xxxxxxxxx[TRUNCATED]"), ("waiting for getByRole('b') x", "[INTERNAL_TARGET]")]
    got = spark.createDataFrame(said, "t string, w string").select("w", labels.redact_observed(F.col("t"), 29).alias("r")).collect()
    assert all(r["r"] == r["w"] or len(r["w"]) > 29 for r in got[:4]) and [r["r"] for r in got[3:4]] == ["[EMPTY]"]
    full = spark.createDataFrame(said, "t string, w string").select("w", labels.redact_observed(F.col("t")).alias("r")).collect()
    assert all(r["r"] == r["w"] for r in full if "TRUNCATED" not in r["w"])
    url = spark.createDataFrame([("see https://u:p@h/x",), ("",)], "t string").select(labels.redact_connector(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in url] == ["see https://[REDACTED]@h/x", "Source connector operation failed"]


def test_optional_segments_in_the_middle_give_no_path(spark):
    paths = [("/a/{b?}/{c?}", ["/a", "/a/{b}", "/a/{b}/{c}"]), ("/{x?}", ["/", "/{x}"]), ("/a/{b?}/c", None), ("/plain/{id}", ["/plain/{id}"]), ("/" + "{a?}/" * 9, None)]
    got = spark.createDataFrame([(p,) for p, _ in paths], "p string").select("p", labels.optional_paths(F.col("p")).alias("v")).collect()
    assert {r["p"]: r["v"] for r in got} == dict(paths)


def test_windows_close_when_the_watermark_passes(spark, tmp_path):
    import datetime as dt

    rows = [(1, dt.datetime(2024, 1, 1, h, 5), "view", 1.0) for h in range(6)]
    path = str(tmp_path / "events")
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(path)
    closed = event_log.hourly(spark, path, spark.read.parquet(path).schema, "1 hour").collect()
    assert {r["start"].hour for r in closed} <= set(range(5)) and len(event_log.hourly(spark, path, spark.read.parquet(path).schema).collect()) == 6
