"""Operators over nulls: in keys, in contents and in what is compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import links, missions, publish


def test_reducers_tell_nulls_apart(spark):
    rows = [("k", None, 5), ("k", 5, None), ("same", None, 5), ("same", None, 5), (None, 1, 1), (None, 1, 2)]
    df = spark.createDataFrame(rows, "key string, a int, b int")
    got = {r["key"]: (r["versions"], r["conflict"]) for r in missions.reduce_by_key(df, ["key"], F.struct("a", "b")).collect()}
    assert got == {"k": (2, True), "same": (2, False), None: (2, True)}


def test_a_value_that_moves_beside_a_null_is_a_new_revision(spark, tmp_path):
    schema = "id string, kind string, title string, tags array<string>"
    none = spark.createDataFrame([], "id string, from_id string, to_id string, tier string, review_state string")
    node = lambda *r: spark.createDataFrame([("n", *r)], schema)
    tries = [node("x", None, None), node(None, "x", None), node(None, "x", ["a", None]), node(None, "x", [None, "a"]), node(None, "x", ["a"])]
    assert [publish.publish(spark, str(tmp_path), n, none) for n in tries] == [1, 2, 3, 4, 5]
    assert publish.publish(spark, str(tmp_path), tries[-1], none) == 5
    assert publish.publish(spark, str(tmp_path), tries[-1].withColumn("more", F.lit(None).cast("string")), none) == 6


def test_pages_without_a_key_have_no_owner(spark):
    rows = [(1, "u", "x"), (2, None, "x"), (3, None, "y"), (4, None, None), (5, None, None), (6, "v", None), (7, "v", "z"), (7, "v", "z"), (8, "w", "y")]
    got = links.first_owners(spark.createDataFrame(rows, "id long, uri string, content string"), "id", ["uri", "content"])
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4, 5, 6]


def test_versions_of_a_null_key_are_one_group(spark):
    rows = [(None, 0, 1, "a"), (None, 1, 2, "b"), (None, 2, 2, "b"), (None, 3, 2, None), (None, 4, 4, "d"), ("k", 0, 1, None), ("k", 1, 1, None), ("k", 2, None, "a")]
    df = spark.createDataFrame(rows, "key string, at int, version int, payload string")
    got = {(r["key"], r["at"]): r["outcome"] for r in missions.accept_versions(df, "key", ["at"], "version", "payload").collect()}
    assert got == {(None, 0): "appended", (None, 1): "appended", (None, 2): "repeated", (None, 3): "conflict", (None, 4): "gap", ("k", 0): "appended", ("k", 1): "repeated", ("k", 2): "gap"}
