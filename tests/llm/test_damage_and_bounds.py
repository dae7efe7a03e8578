"""Damaged and oddly written WARC bytes (operator 10), the bounds and the fit of the language machines (4), long texts of the line field (3), edge
cases of the encoder (9)."""

from __future__ import annotations

import gzip
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import bpe_queue, language_tree, line_crf, linear_svm, warc_derivatives as warc


def response(i: int, body: bytes = b"<p>text", http: str = "", **more) -> tuple[dict, bytes]:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + http.encode() + b"\r\n" + body
    return {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{i}>", "Content-Length": str(len(block)), **more}, block


def found(spark, *files: bytes) -> list[list[str]]:
    df = spark.createDataFrame([(f,) for f in files], "content binary").coalesce(1)
    return [r["record_id"] for r in warc.records_in(df).collect()], [tuple(r) for r in warc.file_reports(df).collect()]


def test_damage_ends_a_file_and_is_counted(spark):
    members = [gzip.compress(warc.serialise(*response(i, b"x" * 5000))) for i in range(3)]
    whole = b"".join(members)
    torn = bytearray(whole)
    torn[len(members[0]) + 30] ^= 0xFF  # inside the second member
    plain = b"".join(warc.serialise(*response(i)) for i in range(2))
    ids, reports = found(spark, bytes(torn), whole + b"no gzip", whole[:-9], plain[:-12], b"\x1f\x8bjunk", b"junk that is nothing", None, b"", whole + b"\0" * 600)
    assert reports[1] == (3, "gzip") and reports[0][1] == "gzip" and reports[0][0] in (1, 2) and reports[2][1] == "gzip"
    assert reports[3:] == [(1, "cut"), (0, "gzip"), (0, "no record"), (0, None), (0, None), (3, None)]
    assert len(ids) == sum(n for n, _ in reports)


def test_field_names_in_any_case(spark):
    headers, block = response(1, **{"WARC-Target-URI": "http://a/b", "WARC-Date": "2020-01-01T00:00:00Z", "X-Own": "kept"})
    odd = {k.swapcase() if k != "X-Own" else k: v for k, v in headers.items()}
    df = spark.createDataFrame([(warc.serialise(odd, block),), (warc.serialise(headers, block),)], "content binary")
    a, b = warc.records_in(df).collect()
    assert a == b and a["record_id"] == "<urn:uuid:1>" and a["headers"]["X-Own"] == "kept"
    assert {r["target_uri"] for r in warc.derivatives(warc.records_in(df)).collect()} == {"http://a/b"}
    assert warc.derive("<x>", {k.lower(): v for k, v in headers.items()}, block) == warc.derive("<x>", headers, block)


@pytest.mark.parametrize("way", ["chunked", "gzip", "deflate", "raw deflate", "both", "torn gzip", "torn chunk", "not chunked", "not gzip", "br"])
def test_encoded_payloads_are_read(way):
    page = "<title>Café</title><p>hello " + "words " * 3000
    raw = page.encode()
    chunks = lambda d: b"".join(b"%x;ext=1\r\n" % len(d[a : a + 999]) + d[a : a + 999] + b"\r\n" for a in range(0, len(d), 999)) + b"0\r\n\r\n"
    flat = zlib.compressobj(wbits=-15)
    body, http = {
        "chunked": (chunks(raw), "Transfer-Encoding: chunked"), "gzip": (gzip.compress(raw), "Content-Encoding: gzip"), "deflate": (zlib.compress(raw), "Content-Encoding: deflate"),
        "raw deflate": (flat.compress(raw) + flat.flush(), "Content-Encoding: DEFLATE"), "both": (chunks(gzip.compress(raw)), "Transfer-Encoding: chunked\r\nContent-Encoding: gzip"),
        "torn gzip": (gzip.compress(raw)[:-20], "Content-Encoding: gzip"), "torn chunk": (chunks(raw)[:2000], "Transfer-Encoding: chunked"), "not chunked": (raw, "Transfer-Encoding: chunked"),
        "not gzip": (raw, "Content-Encoding: gzip"), "br": (raw, "Content-Encoding: br"),
    }[way]
    headers, block = response(1, body, http + "\r\n")
    meta, text = warc.derive("<x>", headers, block)
    assert meta["source_payload_digest"] == warc.digest(body) and b"Caf\xc3\xa9" in meta["block"]
    got = text["block"].decode()
    assert got.startswith("Café\nhello words") and (way.startswith("torn") or got == warc.html_text(page))


def test_the_sample_is_bounded_under_repeated_ids(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(language_tree, "fit_tree", lambda x, langs: got.update(Counter(langs)) or {"n": len(x)})
    many = spark.range(30_000).selectExpr("7L as doc_id", "concat('wort ', id % 977) as text", "'de' as lang")
    few = spark.range(3000).selectExpr("id + 10 as doc_id", "concat('word ', id) as text", "if(id % 3 = 0, 'fr', 'en') as lang")
    language_tree.learn(many.union(few), per_language=200, max_rows=500)
    assert all(v <= 166 for v in got.values()) and got["de"] > 100 and got["en"] > 100 and got["fr"] > 100
    same = spark.range(3000).selectExpr("id as doc_id", "'gleich' as text", "'de' as lang").union(few)
    assert language_tree.learn(same, per_language=50)["n"] <= 150


def test_four_hundred_languages_make_a_bounded_tree():
    rng = np.random.default_rng(1)
    names = sorted([f"q{i:03d}" for i in range(391)] + ["de", "en", "fr", "it", "ru", "pl", "fi", "et", "hi"])
    close = rng.normal(size=(40, 64))  # ten languages around each point
    x = np.stack([close[i % 40] + 0.1 * rng.normal(size=64) for i in range(len(names))])
    of = language_tree.families(names, x)
    sizes = Counter(v for k, v in of.items() if k.startswith("q"))
    assert set(of) == set(names) and max(sizes.values()) <= language_tree.MEMBERS and of["de"] == "germanic"
    every = Counter(of.values())
    assert len(every) * (len(every) - 1) // 2 + sum(n * (n - 1) // 2 for n in every.values()) <= 4200
    assert language_tree.families(names, x) == of and language_tree.families([], np.zeros((0, 3))) == {}


def test_unknown_languages_are_told_apart(spark):
    rng = np.random.default_rng(2)
    sound = {f"q{i}": ["".join(rng.choice(list("abcdefghijklmnop"), 3)) for _ in range(6)] for i in range(15)}
    text = lambda la: " ".join(rng.choice(sound[la]) + rng.choice(sound[la]) for _ in range(40))
    rows = [(i, text(la), la) for i, la in enumerate(sorted(sound) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tree = language_tree.learn(df.where("doc_id < 150"))
    assert len(tree["members"]) == 2 and all(len(m) <= language_tree.MEMBERS for m in tree["members"].values())
    held = df.where("doc_id >= 150").collect()
    assert sum(language_tree.predict(tree, language_tree.ngram_counts(r["text"])[0])[0] == r["lang"] for r in held) >= 0.9 * len(held)


def test_machines_reach_the_minimum_of_a_plain_descent():
    """The fitted loss is that of a plain gradient descent of many steps, written out by row, and so are the signs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] + 0.3 + 0.5 * rng.normal(size=30) > 0, 1.0, -1.0)
    pos = int((y > 0).sum())
    weight = [10.0 / 30 * 30 / (2 * (pos if t > 0 else 30 - pos)) for t in y]

    def loss(w, b):
        return 0.5 * sum(v * v for v in w) + sum(c * max(0.0, 1 - t * (sum(p * q for p, q in zip(r, w)) + b)) ** 2 for c, r, t in zip(weight, x, y))

    w, b = [0.0] * 3, 0.0
    for _ in range(4000):
        gw, gb = list(w), 0.0
        for c, r, t in zip(weight, x, y):
            m = max(0.0, 1 - t * (sum(p * q for p, q in zip(r, w)) + b))
            gw = [g - 2 * c * m * t * p for g, p in zip(gw, r)]
            gb -= 2 * c * m * t
        w, b = [v - 0.01 * g for v, g in zip(w, gw)], b - 0.01 * gb
    fw, fb = linear_svm.fit(x, y)
    assert abs(loss(fw, fb) - loss(w, b)) < 1e-3 * loss(w, b)
    assert all(np.sign(x @ fw + fb) == np.sign(x @ np.array(w) + b))


def test_marginals_of_long_texts_in_blocks():
    rng = np.random.default_rng(5)
    w, move = rng.normal(size=4), rng.normal(size=(2, 2))
    for n in (1, 2, 63, 64, 65, 1000):
        x = rng.normal(size=(n, 4)).astype(np.float32)
        unary = np.stack([np.zeros(n), x @ w], axis=1)[None]
        want = line_crf.forward_backward(unary, move, np.array([n]))[0][0, :, 1]
        for block in (1, 64, 1 << 16):
            assert np.allclose(line_crf.bad_marginals(x, w, move, block), want, atol=1e-9)
    x, size = line_crf.line_features("short line\n" * 200_000)
    assert len(line_crf.bad_marginals(x, rng.normal(size=x.shape[1]), move)) == len(size) == 200_001


def test_encoder_edges(spark):
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    run = lambda rows, schema="doc_id long, text string, ids string, n_tokens int, decoded string": bpe_queue.encode_texts(spark.createDataFrame(rows, schema), path, public.PATTERN)
    assert run([]).count() == 0
    long = "ab" * 300_000  # one pre-token
    got = run([(1, "twice", "x", 1, "y"), (1, "twice", "x", 1, "y"), (None, long, None, None, None), (2, None, "x", 0, "z")]).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"]))] == [1, 1, 2, None]
    assert len({(r["n_tokens"], bytes(r["ids"])) for r in got if r["doc_id"] == 1}) == 1
    assert all(bytes(r["decoded"]).decode() == {1: "twice", 2: "", None: long}[r["doc_id"]] for r in got)
