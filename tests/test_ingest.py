"""Files and records from outside: quarantine, excerpts, documentation files and the artifact store."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from strandline.sources import ingest


def test_every_record_is_accounted_for(spark):
    s = '{"id":"1","file_path":"a","qualified_name":"A","kind":"class","start_line":1,"end_line":2,"extra":0}'
    docs = [
        ("good", '{"symbols":[%s,%s],"routes":[{"id":"r","methods":["GET"],"path":"/x"}]}' % (s, s)), ("empty", "{}"), ("null", None), ("cut", '{"symbols":[%s' % s), ("list", "[1]"), ("text", "hello"),
        ("bad", '{"symbols":[null,"x",7,{"id":"2"},{"id":"3","file_path":"a","qualified_name":"A","kind":"c","start_line":5,"end_line":4},{"id":"4","file_path":"a","qualified_name":"A","kind":"c","start_line":"x"}],"references":[{"id":"5","kind":"call"}]}'),
        ("long", '{"pad":"%s"}' % ("x" * 5000)), ("many", '{"references":[%s]}' % ",".join(['{"id":"1","source_symbol_id":"s","kind":"k"}'] * 9)),
    ]
    got = ingest.index_output(spark.createDataFrame(docs, "path string, document string"), max_bytes=4000, max_records=8)
    assert {k: v.count() for k, v in got.tables.items()} == {"symbols": 2, "references": 0, "routes": 1}
    assert got.tables["routes"].first()["methods"] == ["GET"]
    bad = sorted((r["path"], r["subject"], r["reason"]) for r in got.quarantine.collect())
    assert bad == sorted(
        [("null", "output", "missing"), ("cut", "output", "corrupt"), ("list", "output", "corrupt"), ("text", "output", "corrupt"), ("long", "output", "too_large"), ("many", "output", "too_many_records"), ("bad", "references", "missing_field")]
        + [("bad", "symbols", "corrupt")] * 4 + [("bad", "symbols", "missing_field"), ("bad", "symbols", "invalid_range")]
    )
    none = ingest.index_output(spark.createDataFrame([], "path string, document string"))
    assert none.quarantine.count() == none.tables["symbols"].count() == 0


def test_excerpts_keep_whole_code_points(spark):
    text = "aé€😀" * 5
    raw = text.encode()
    df = spark.createDataFrame([(i, j, bytearray(raw)) for i in range(0, 14) for j in range(0, 18)] + [(-3, 4, bytearray(raw)), (90, 99, bytearray(raw)), (0, 5, None)], "i int, j int, content binary")
    for r in df.select("i", "j", "content", ingest.excerpt(F.col("content"), F.col("i"), F.col("j")).alias("x")).collect():
        want, at = "", 0
        for c in text:
            want += c if at >= r["i"] and at + len(c.encode()) <= r["j"] else ""
            at += len(c.encode())
        assert r["x"] == (want if r["content"] is not None else None), (r["i"], r["j"])
    secret = b"token ghp_" + b"a1B2" * 9 + b" end"
    got = spark.createDataFrame([(bytearray(secret),)], "content binary").select(ingest.excerpt(F.col("content"), F.lit(0), F.lit(99)).alias("x")).first()["x"]
    assert "a1B2a1B2" not in got


def test_documentation_files(spark, tmp_path):
    files = {"readme.md": "# Hé".encode(), "docs/a/guide.MDX": b"text", "docs/bad.md": b"\xff\xfe", "docs/big.md": b"x" * 3000, "code.py": b"x = 1", "empty.md": b""}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r for r in ingest.documentation(spark, str(tmp_path), max_bytes=2000).collect()}
    assert set(got) == set(files) - {"code.py", "empty.md"}
    assert got["readme.md"]["text"] == "# Hé" and got["docs/a/guide.MDX"]["content_hash"] == hashlib.sha256(b"text").hexdigest()
    assert (got["docs/bad.md"]["text"], got["docs/bad.md"]["problem"]) == (None, "not_utf8") and (got["docs/big.md"]["size"], got["docs/big.md"]["problem"]) == (3000, "too_large")


def test_artifacts_are_stored_once(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    table = lambda *rows: spark.createDataFrame([(None if c is None else bytearray(c), m) for c, m in rows], "content binary, media_type string")
    assert ingest.artifacts(spark, root).count() == 0
    first = table((b"a", "text/plain"), (b"a", "a/first"), (b"", "none"), (None, "lost"), (b"\x00\xff", None))
    assert ingest.persist(first, root) == 3 and ingest.persist(first, root) == 0 and ingest.persist(table((b"b", "x"), (b"a", "y")), root) == 1
    got = {bytes(r["content"]): (r["digest"], r["size"], r["media_type"]) for r in ingest.artifacts(spark, root).collect()}
    assert got == {c: (hashlib.sha256(c).hexdigest(), len(c), m) for c, m in ((b"a", "a/first"), (b"", "none"), (b"\x00\xff", None), (b"b", "x"))}
    assert ingest.damaged(spark, root).count() == 0
