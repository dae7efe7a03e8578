"""Policies with exceptions, redacted addresses, and the run's own secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import rules
from strandline.operators import policy


def test_licences_and_advisories(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    inventory = t([("a", "1", "MIT"), ("b", "1", "GPL"), ("b", "1", "GPL"), ("b", "2", "GPL"), ("c", "1", None), ("d", "1", "GPL")], "package string, version string, license string")
    excused = t([("b", "1", "GPL", "2026-01-01"), ("d", "1", "GPL", "2025-12-31"), ("b", "2", "MIT", "2030-01-01"), (None, "2", "GPL", "2030-01-01")], "package string, version string, license string, expires_on string")
    got = policy.license_violations(inventory, t([("MIT",), (None,)], "license string"), excused, "2026-01-01")
    assert {tuple(r) for r in got.collect()} == {("b", "2", "GPL"), ("c", "1", None), ("d", "1", "GPL")} and got.count() == 3
    advisories = t([("x", "p", "high"), ("x", "p", "low"), ("y", "p", "low"), ("z", "p", "moderate"), ("w", "p", None), ("x", "p", "high")], "advisory string, package string, severity string")
    excused = t([("x", "p", "high", "2030-01-01"), ("x", "p", "low", "2030-01-01"), ("z", "p", "moderate", "2020-01-01"), ("y", "q", "low", "2030-01-01")], "advisory string, package string, severity string, expires_on string")
    got = policy.dependency_violations(advisories, excused, "2026-01-01")
    assert {tuple(r) for r in got.collect()} == {("x", "p", "high"), ("y", "p", "low"), ("z", "p", "moderate"), ("w", "p", None)} and got.count() == 4
    assert policy.license_violations(inventory.limit(0), inventory.select("license"), excused.select("package", F.lit("1").alias("version"), F.lit("x").alias("license"), "expires_on"), "2026-01-01").count() == 0


def test_redacted_addresses(spark):
    cases = {
        "https://u:p@Host.example/a/b?q=1#f": "https://host.example/a/b", "http://h": "http://h/", "http://h/": "http://h/", "http://h/orders/12345": "http://h/orders/redacted", "http://h/token/abc/x": "http://h/token/redacted/x",
        "http://h/Magic-Link/abc": "http://h/Magic-Link/redacted", "http://h/a%2Gb": "http://h/redacted", "http://h/%ff/x": "http://h/redacted/redacted", "http://h/caf%C3%A9/x+y": "http://h/caf%C3%A9/x+y", "http://h/AbcdefGhijklm": "http://h/redacted",
        "http://h/abcdefghijklm": "http://h/abcdefghijklm", "http://h/abcdefghijkl1234": "http://h/redacted", "http://h/me%40x.org/": "http://h/redacted/", "http://h/is-my-key/x": "http://h/redacted/x", "http://h//a": "http://h//a", "no address": None, None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", rules.redact_url(F.col("u"), F.array(F.lit("my-key"), F.lit(None).cast("string"), F.lit(""))).alias("r"))
    assert {r["u"]: r["r"] for r in df.collect()} == cases


def test_own_secrets_go_first(spark):
    blank = chr(0xA0) + chr(0x3000)
    rows = [("key is abcd and abcdef" + blank + "end", ["abcd", "abcdef", None, ""]), ("a" + blank + "b", None), (blank, []), (None, ["x"])]
    df = spark.createDataFrame(rows, "t string, s array<string>").select(rules.redact_observed(F.col("t"), 4096, F.col("s")).alias("r"))
    assert [r["r"] for r in df.collect()] == ["key is [REDACTED] and [REDACTED] end", "a b", "[EMPTY]", None]
