"""Operators 11 and 12 against plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from strandline.llm import fill_in_middle, registry, secret_index
from strandline.llm.secret_index import Rule

# ---- op11


def spans(text: str, rules) -> list[tuple[int, int, int]]:
    return sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)


def texts_with_secrets(rng: random.Random) -> list[str | None]:
    parts = ["password", "PassWd", "token", "api_key", "ApiKey", "secret", ":", "=", " ", " ", '"', "'", "\n", "é", "😀", "a1b2c3d4", "x" * 7, "AKIA", "AKIAABCDEFGH1234", "0" * 31, "f" * 32, "zz",
             "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "ghp_" + "Ab1" * 9, "xoxb-" + "1a-" * 9, "eyJ" + "a" * 15 + ".eyJ" + "b" * 15 + ".c-_", "ſecret", "toKen"]
    out: list[str | None] = [None, "", "ab", "token=secret:abcdefghij", "password = 'hunter2hunter2'", "secret:" + "k" * 3_000_000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]


def test_spans_equal_a_scan_of_every_text(spark):
    texts = texts_with_secrets(random.Random(3))
    rows = [(i // 2, t, "x", 7) for i, t in enumerate(texts)]  # every id twice
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int")
    got = secret_index.search_index(secret_index.build_index(df, segment_bytes=2000)).collect()
    want = []
    for i, t in enumerate(texts):
        found = spans(t or "", secret_index.RULES)
        said = lambda f: ",".join(f"{secret_index.RULES[k].kind}:{s}:{e}" for s, k, e in f)
        want.append((i // 2, *[sum(k == j for _, k, _ in found) for j in range(6)], said([f for f in found if f[1] < 3]), said(found)))
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(w[1] for w in want) > 20 and sum(w[4] for w in want) > 5


def test_queries_hold_for_whatever_matches():
    """A text with a match always passes the query of its pattern; patterns are drawn at random."""
    rng = random.Random(5)
    atoms = ["abc", "k", "[ab]", "[^x]", ".", "(?:foo|ba)", "(?:foo|bars?)", "x?", "(?:ab)+", "(?:sk){2}", "q{2,3}", "(?=d)d", "\\d", "[a-h]", "é", "(?i:Kiss)", "(?:abcd|efgh|ijkl)", "\\bw"]
    alphabet = "abcdefghijklqrswxofBAKI1éKſ "
    full = 0
    for _ in range(400):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.3:
            pattern = f"(?i){pattern}"
        query, compiled = secret_index.trigram_query(pattern), re.compile(pattern)
        full += query is not None
        for _ in range(200):
            text = "".join(rng.choice(["abc", "foo", "bar", "kiss", "abcd", "efgh", "sksk", "qq", *alphabet]) for _ in range(rng.randint(1, 9)))
            if compiled.search(text):
                raw = secret_index.np.frombuffer(text.encode(), "u1")
                lists = secret_index._Postings(1, *[x.astype("<i4").tobytes() for x in secret_index._postings(raw, secret_index.np.array([0, len(raw)]))])
                assert list(lists.holding(query)) == [0], (pattern, text)
    assert full > 100


def test_queries_are_selective():
    gram = lambda s: int.from_bytes(s.encode(), "big")
    assert secret_index.trigram_query("[0-9a-f]+") is None
    assert secret_index.trigram_query("AKIA[A-Z]+") == ("and", frozenset({gram("aki"), gram("kia")}))
    assert secret_index.trigram_query("abcd|xyz") == ("or", frozenset({("and", frozenset({gram("abc"), gram("bcd")})), gram("xyz")}))
    assert gram("ey-") in secret_index.trigram_query(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")[1]


def test_letters_that_fold_to_ascii():
    for c in "abcdefghijklmnopqrstuvwxyz":
        other = {chr(k) for k in range(0x80, 0x110000) if not 0xD800 <= k < 0xE000 and re.fullmatch(f"(?i){c}", chr(k))}
        assert other == set(secret_index._FOLDS.get(c, ""))


def test_segments_of_an_index_can_be_searched_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "one needle here"), (2, "hay"), (None, "NEEDLES and a needle"), (4, None)], "doc_id long, text string")
    path = str(tmp_path / "index")
    secret_index.build_index(df, segment_bytes=8).write.parquet(path)
    got = secret_index.search_index(spark.read.parquet(path), (Rule("needle", "(?i)needle"), Rule("hay", "hay")), base=1).collect()
    assert {(r["doc_id"], r["n_needle"], r["n_hay"], r["base_spans"], r["spans"]) for r in got} == {
        (1, 1, 0, "needle:4:10", "needle:4:10"), (2, 0, 1, "", "hay:0:3"), (None, 2, 0, "needle:0:6,needle:14:20", "needle:0:6,needle:14:20"), (4, 0, 0, "", "")
    }


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secret_index.search_index(secret_index.build_index(none)).collect() == []
    assert fill_in_middle.fill_in_middle(none).collect() == []


# ---- op12


def arranged(ident, text: str | None, units: str) -> tuple:
    text = text or ""
    h = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    parts = re.findall(units, text)
    a, b = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    if not text or any(s in text for s in fill_in_middle.SENTINELS) or h3 % 100 >= 90:
        return ident, len(parts), "plain", None, None, text
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h4 % 100 < 20:
        return ident, len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return ident, len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", sorted(fill_in_middle.UNITS))
def test_arrangements_equal_plain_python_and_restore(spark, unit):
    rng = random.Random(11)
    texts: list[str | None] = [None, "", "a", "<P>", "x<S>y", "<M", "<P", "S>", "\n", "\r\n\r\n", "é😀" * 9, "<<P<S<M>", "a b\u0085c", "long " * 40_000]
    texts += ["".join(rng.choice(["<", ">", "P", "S", "M", " ", "\n", "\t", "é", "😀", "ab", "\\", "$1"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = [(i // 2, t, "form", 1) for i, t in enumerate(texts)] + [(None, "no id <", "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, units int")
    made = fill_in_middle.fill_in_middle(df, unit=unit)
    got = made.select("*", fill_in_middle.restore(made["output"], made["form"]).alias("back")).collect()
    pattern = {"character": r"(?s).", "word": r"(?a)\s+|\S+\s*", "line": r"[^\n]*\n|[^\n]+"}[unit]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:-1] for r in got], key=key) == sorted([arranged(r[0], r[1], pattern) for r in rows], key=key)
    assert sorted(r["back"] for r in got) == sorted(r[1] or "" for r in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_sentinels_must_not_overlap(spark):
    df = spark.createDataFrame([(1, "t")], "doc_id long, text string")
    for bad in (("aba", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("", "a", "b"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(df, sentinels=bad)


def test_queries_cover_all_documents(spark):
    from conftest import SMALL

    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op11_secret_index", "op12_fill_in_middle"):
        assert registry.queries()[name](spark, SMALL).count() == n
