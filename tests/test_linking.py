"""Claims to links: every reason in its order, both sides, ties, nulls and empty sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import linking

CLAIMS = "claim_id string, application_id string, from_id string, relationship string, to_id string, assertion string, explanation string, submitted boolean, evidence_ids array<string>"
EVIDENCE = "evidence_id string, application_id string, status string, method string, source_kind string, run_id string, commit_sha string, artifact_id string, captured_at string, bindings array<struct<from_id:string,relationship:string,to_id:string>>"
ANY = [("a", "CALLS", "b"), ("a", "RENDERED_BY", "b"), ("x", "CALLS", "y"), ("p", "CALLS", "q")]


def run(spark, claims, evidence):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    policy = of([("CALLS", "c", "call", "A"), ("CALLS", "c", "reference", "A"), ("RENDERED_BY", "route", "route", "B"), ("RENDERED_BY", "text", "text", "B")], "relationship string, clause string, method string, tier string")
    methods = of([("call", "repository"), ("reference", "repository"), ("route", "repository"), ("text", "browser")], "method string, source_kind string")
    return linking.link(of(claims, CLAIMS), of(evidence, EVIDENCE), policy, "app", methods, of([("r1",), ("r2",)], "run_id string"), of([("c1",)], "commit_sha string"))


def ev(i, method="call", source="repository", **kw):
    row = {"application_id": "app", "status": "captured", "run_id": "r1", "commit_sha": "c1", "artifact_id": None, "captured_at": "2024-01-01", "bindings": ANY} | kw
    return (i, row["application_id"], row["status"], method, source, row["run_id"], row["commit_sha"], row["artifact_id"], row["captured_at"], row["bindings"])


def claim(i, evidence_ids, rel="CALLS", ends=("a", "b"), side="supports", **kw):
    return (i, kw.get("application_id", "app"), ends[0], rel, ends[1], side, kw.get("why", "because"), kw.get("submitted", True), evidence_ids)


def test_each_reason_and_outcome(spark):
    evidence = [
        ev("ok"), ev("ok2", "reference", run_id="r2", captured_at="2024-03-01", commit_sha=None), ev("alien", application_id="other"), ev("failed", status="failed"), ev("odd", source="browser"),
        ev("run", run_id="r9"), ev("commit", commit_sha="c9"), ev("route", "route"), ev("text", "text", "browser"), ev("loose", bindings=[("a", "CALLS", "z")]), ev("bare", bindings=None), ev("ok"),
    ]
    claims = [
        claim("1", ["ok"], application_id="other"), claim("2", ["ok", "gone", "alien"]), claim("3", ["alien", "gone"]), claim("4", ["failed"]), claim("5", ["odd"]), claim("6", ["run"]), claim("7", ["commit"]),
        claim("8", ["ok"], rel="COVERED"), claim("9", ["text"]), claim("10", ["route"], rel="RENDERED_BY"), claim("11", ["loose"]), claim("12", ["bare"]), claim("13", None), claim("14", []),
        claim("link1", ["ok"], why="b"), claim("link2", ["ok2"], why="a"), claim("link2", ["ok2"], why="a"), claim("free", ["loose"], submitted=False, why=None), claim("both", ["route", "text"], rel="RENDERED_BY"),
        claim("yes", ["ok"], ends=("x", "y")), claim("no", ["ok2"], ends=("x", "y"), side="contradicts"), claim("open", ["ok"], ends=("p", "q"), side="contradicts"), claim("15", [None]),
    ]
    got = run(spark, claims, evidence)
    codes = {r["claim_id"]: (r["outcome"], r["code"]) for r in got.outcomes.collect()}
    want = ["application_mismatch", "missing_evidence", "application_mismatch", "invalid_evidence_status", "unsupported_source", "incompatible_run", "incompatible_commit", "unsupported_relationship_evidence"]
    want += ["unsupported_relationship_evidence", "required_evidence_missing", "evidence_binding_mismatch", "evidence_binding_mismatch", "required_evidence_missing", "required_evidence_missing", "missing_evidence"]
    assert [codes.pop(str(i + 1)) for i in range(15)] == [("rejected", c) for c in want]
    assert codes == {k: (v, None) for k, v in {"link1": "linked", "link2": "linked", "free": "linked", "both": "linked", "yes": "conflict", "no": "conflict", "open": "open"}.items()}
    assert got.counts == {"linked": 4, "conflict": 2, "rejected": 15, "open": 1} and got.outcomes.count() == 22
    links = {(r["from_id"], r["relationship"]): r for r in got.links.collect()}
    a = links["a", "CALLS"]
    assert (a["tier"], a["extraction_method"], a["explanation"], a["evidence_ids"]) == ("A", "corroborated:call+reference", "a | b", ["loose", "ok", "ok2"])
    assert (a["commit_sha"], a["run_id"], a["last_confirmed_at"], a["review_state"]) == ("c1", None, "2024-03-01", "not_required")
    assert links["a", "RENDERED_BY"]["extraction_method"] == "corroborated:route+text" and len(links) == 2
    [c] = got.conflicts.collect()
    assert (c["supporting"], c["contradicting"], c["evidence_ids"]) == (["yes"], ["no"], ["ok", "ok2"])
    ids = {r["link_id"] for r in got.outcomes.where("outcome = 'conflict'").collect()}
    assert ids == {c["link_id"]} and a["link_id"] in {r["link_id"] for r in got.outcomes.collect()}
    assert {r["evidence_id"]: r["code"] for r in got.evidence.collect()} == {"alien": want[0], "failed": want[3], "odd": want[4], "run": want[5], "commit": want[6]}


def test_empty_sides(spark):
    got = run(spark, [], [ev("ok")])
    assert got.outcomes.count() == got.links.count() == got.conflicts.count() == 0 and sum(got.counts.values()) == 0
    got = run(spark, [claim("1", ["ok"])], [])
    assert [tuple(r)[:3] for r in got.outcomes.collect()] == [("1", "rejected", "missing_evidence")]
    assert got.outcomes.where(F.col("link_id").isNotNull()).count() == 0
