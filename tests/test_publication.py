"""Publication: failures between its steps, two publishers at once, rollback, and document maps."""

from __future__ import annotations

import pytest

from strandline.operators import publish


def graph(spark, titles):
    nodes = spark.createDataFrame(list(titles.items()), "id string, title string")
    edges = spark.createDataFrame([("e", *sorted(titles)[:2], "A", "accepted")], "id string, from_id string, to_id string, tier string, review_state string")
    return nodes, edges


def titles(spark, root):
    return {r["id"]: r["title"] for r in publish.read(spark, root, "nodes").collect()}


def test_a_failure_before_activation_leaves_readers_on_the_old_revision(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    assert publish.publish(spark, root, *graph(spark, {"a": "1", "b": "1"})) == 1
    real = publish.activate
    monkeypatch.setattr(publish, "activate", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        publish.publish(spark, root, *graph(spark, {"a": "2", "b": "2"}))
    monkeypatch.setattr(publish, "activate", real)
    assert titles(spark, root) == {"a": "1", "b": "1"} and publish.current(spark, root) == 1
    assert {(r["table"], r["revision"]) for r in publish.pending(spark, root).collect()} == {("nodes", 2), ("edges", 2)}
    assert publish.rollback(spark, root) == 2 and publish.rollback(spark, root) == 0 and publish.pending(spark, root).isEmpty()
    assert publish.publish(spark, root, *graph(spark, {"a": "2", "b": "2"})) == 2 and titles(spark, root) == {"a": "2", "b": "2"}


def test_one_of_two_publishers_gets_the_revision(spark, tmp_path):
    root = f"file://{tmp_path}"
    first, second = publish.stage(spark, root, *graph(spark, {"a": "x", "b": "x"})), publish.stage(spark, root, *graph(spark, {"a": "y", "b": "y"}))
    assert publish.activate(spark, root, second) == 1
    with pytest.raises(publish.RevisionTaken):
        publish.activate(spark, root, first)
    assert titles(spark, root) == {"a": "y", "b": "y"} and publish.rollback(spark, root) == 2 and titles(spark, root) == {"a": "y", "b": "y"}


def test_an_invalid_revision_can_be_rolled_back(spark, tmp_path):
    root = f"file://{tmp_path}"
    nodes, edges = graph(spark, {"a": "1", "b": "1"})
    with pytest.raises(publish.InvalidPublication, match="missing_to"):
        publish.publish(spark, root, nodes.where("id = 'a'"), edges)
    assert publish.current(spark, root) is None and publish.rollback(spark, root) == 2
    assert publish.publish(spark, root, nodes, edges) == 1


def test_maps_are_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    table = lambda *rows: spark.createDataFrame(list(rows), "id string, title string")
    assert publish.replace_map(spark, root, "one", {"pages": table(("p", "1"), ("q", None)), "links": table(("l", "x"))}) == 1
    assert publish.replace_map(spark, root, "two", {"pages": table(("p", "2")), "links": table()}) == 1
    assert publish.replace_map(spark, root, "one", {"pages": table(("q", None), ("p", "1")), "links": table(("l", "x"))}) == 1  # the same rows
    assert publish.replace_map(spark, root, "one", {"pages": table(("q", "1"), ("p", None)), "links": table(("l", "x"))}) == 2
    monkeypatch.setattr(publish, "_claim", lambda *a: False)
    with pytest.raises(publish.RevisionTaken):
        publish.replace_map(spark, root, "two", {"pages": table(), "links": table()})
    assert {tuple(r) for r in publish.read_map(spark, root, "pages").select("scope", "id", "title").collect()} == {("one", "q", "1"), ("one", "p", None), ("two", "p", "2")}
    assert {(r["scope"], r["version"]) for r in publish.maps(spark, root).collect()} == {("one", 2), ("two", 1)}
    assert publish.maps(spark, f"{root}/none").count() == 0
