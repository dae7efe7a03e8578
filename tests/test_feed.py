"""The feed over restarts: any split of the events into runs delivers what one run does."""

from __future__ import annotations

import random
import time

from strandline.streaming import feed

SCHEMA = "k string, n long, c string"


def add(spark, rows, path, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_two_runs_equal_one(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, n, f"{k}{n}") for k in ("a", "b", "c") for n in range(1, 30)]
    rng.shuffle(rows)
    rows += rows[:10] + [(None, 1, "x"), ("a", None, "x"), ("a", 0, "x"), ("d", 2, None)]
    cols = {"key": "k", "number": "n", "content": "c"}
    add(spark, rows[:40], tmp_path / "in", "1")
    first = feed.catch_up(stream(spark, str(tmp_path / "in")), str(tmp_path / "two"), **cols).collect()
    assert 0 < len(first) < 60
    add(spark, rows[40:], tmp_path / "in", "2")
    two = feed.catch_up(stream(spark, str(tmp_path / "in")), str(tmp_path / "two"), **cols)
    again = feed.catch_up(stream(spark, str(tmp_path / "in")), str(tmp_path / "two"), **cols)  # nothing new
    one = feed.catch_up(stream(spark, str(tmp_path / "in")), str(tmp_path / "one"), **cols)
    seen = lambda d: sorted((r["key"], r["number"], r["content"], r["outcome"]) for r in d.collect())
    assert seen(two) == seen(one) == seen(again)
    assert [x for x in seen(one) if x[3] == "delivered"] == sorted((k, n, f"{k}{n}", "delivered") for k in "abc" for n in range(1, 30))
    assert sum(x[3] == "replay" for x in seen(one)) == 10  # d waits for its first event


def test_conflicts_and_gaps(spark, tmp_path):
    cols = {"key": "k", "number": "n", "content": "c", "patience_ms": 1}
    add(spark, [("a", 1, "x"), ("a", 3, "z"), ("a", 1, "y other"), ("a", 3, "z2")], tmp_path / "in", "1")
    feed.catch_up(stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), **cols)
    time.sleep(0.2)
    add(spark, [("b", 1, "q")], tmp_path / "in", "2")
    got = feed.catch_up(stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), **cols).collect()
    assert {(r["key"], r["number"], r["outcome"]) for r in got} == {("a", 1, "delivered"), ("a", 1, "conflict"), ("a", 3, "conflict"), ("a", 2, "gap"), ("b", 1, "delivered")}
    add(spark, [("a", 2, "y")], tmp_path / "in", "3")
    got = feed.catch_up(stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), **cols).collect()
    assert [(r["number"], r["content"]) for r in sorted((x for x in got if x["key"] == "a" and x["outcome"] == "delivered"), key=lambda x: x["number"])] == [(1, "x"), (2, "y"), (3, "z")]
