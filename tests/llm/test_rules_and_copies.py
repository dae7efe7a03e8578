"""Operators 1, 2 and 8 against versions in plain Python, and their edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from strandline.llm import close_vectors, components, host_rules, near_copies, registry, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(rng: random.Random, n: int = 150) -> list[str | None]:
    vocabulary = [w * k for w in ("la", "mé", "Zx", "#1", "q") for k in (1, 2, 3)]
    texts: list[str | None] = [None, "", " \t\n", "one", "Two words", "a b c d", "A b c D", "a\x0bb\x0cc d e", " x y\u0085z w v"]
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in words))
        if rng.random() < 0.5:  # near copies, some of them near others only
            for _ in range(rng.randint(1, 4)):
                words = [rng.choice(vocabulary) if rng.random() < 0.03 else w for w in words]
                texts.append(" ".join(words))
    texts.append(("run of eight words that comes back here \n" * 30) + "end")
    texts.append(" ".join(f"w{i % 97}" for i in range(30_000)))
    return texts


def repeat_words(words: list[str]) -> int:
    at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if at[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_measures_equal_plain_python(spark):
    texts = corpus(random.Random(1), 60)
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in host_rules.apply_host_rules(df).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat_words(words))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_host_verdicts_shrink_and_join_back(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "x"
    data = [("clean", good)] * 40 + [("foul", bad)] * 36 + [("foul", good)] * 4 + [("tiny", bad)] + [(None, good)] * 5
    df = spark.createDataFrame([(i, s, t, 1, True) for i, (s, t) in enumerate(data)], "doc_id long, source string, text string, n_words int, kept boolean")
    got = host_rules.apply_host_rules(df).groupBy("source", "base_failed").agg(F.count_if("kept").alias("kept"), F.max("host_rate").alias("rate")).collect()
    at = {(r["source"], r["base_failed"]): r for r in got}
    assert at["clean", False]["kept"] == 40 and at[None, False]["kept"] == 5
    assert at["foul", False]["kept"] == 0 and at["foul", True]["kept"] == 0  # the host's verdict reaches its clean documents
    assert at["foul", True]["rate"] < 0.9 and at["tiny", True]["rate"] < 1.0  # shrunk towards the rest


def test_host_rules_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "a", 7, "r", True, 1, 2)], "doc_id long, text string, source string, _words int, _reject string, KEPT boolean, N_words int, host int")
    got = host_rules.apply_host_rules(df).collect()[0].asDict()
    assert (got["_words"], got["_reject"], got["host"], got["n_words"], got["kept"]) == (7, "r", 2, 40, True)
    assert "KEPT" not in got and "N_words" not in got and host_rules.apply_host_rules(df, keep_text=False).columns.count("text") == 0


def test_host_rules_of_ties_repeats_and_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    twenty, nineteen = " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(19))
    data = [(1, twenty, "a"), (1, twenty, "a"), (2, nineteen, "a"), (3, long, None), (None, twenty, "a")]
    got = host_rules.apply_host_rules(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    by = sorted((r["doc_id"] or 0, r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in got)
    assert by == [(0, 20, 0, False), (1, 20, 0, False), (1, 20, 0, False), (2, 19, 0, True), (3, 200_000, 200_000, True)]


@pytest.mark.parametrize("name", ["op1_host_rules", "op2_near_copies", "op8_close_vectors"])
def test_queries_equal_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SMALL).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("op", ["rules", "copies"])
def test_empty_table(spark, op):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    out = host_rules.apply_host_rules(df) if op == "rules" else near_copies.near_copies(df)
    assert out.count() == 0


def brute_copies(docs: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = []
    for i, t in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, r in sets[:k]:
            if s and r and 100 * len(s & r) >= percent * len(s | r):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("shingle", "percent"), [(4, 80), (5, 80), (1, 60)])
def test_near_copies_equal_brute_force(spark, shingle, percent):
    docs = [(3 * i + 1, t) for i, t in enumerate(corpus(random.Random(shingle), 90))]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rep string")
    got = near_copies.near_copies(df, shingle, percent).collect()
    want = brute_copies(docs, shingle, percent)
    if percent == 80:
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    else:  # bands are made for 0.8; what is found is still exact
        assert all(r["n_shingles"] == want[r["doc_id"]][0] and r["component_id"] >= want[r["doc_id"]][1] for r in got)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_copies_over_the_small_table(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_copies.op2_near_copies(spark, SMALL).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got == brute_copies(docs, 4, 80)


def test_near_copies_in_parts(spark, monkeypatch):
    """Blocks much larger than a part: the parts of a group meet in all combinations."""
    monkeypatch.setattr(near_copies, "PART_DOCS", 7)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(f"v{rng.randrange(10**6)}" if rng.random() < 0.0005 * i else w for w in base)) for i in range(80)]
    got = near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_copies(docs, 4, 80)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (1, "other words stand here now"), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in near_copies.near_copies(df, 4).collect())
    assert got == [(-1, 47, -1, True), (1, 2, 1, True), (1, 47, 1, True), (1, 47, 1, True), (2, 47, 1, False)]


def test_superminhash_estimates_with_less_variance_than_independent_ranks():
    rng = np.random.default_rng(4)
    err = []
    for _ in range(150):
        x = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = np.sort(x[:50]), np.sort(x[10:])  # similarity 40 / 60
        err.append(np.mean(near_copies.superminhash(a) == near_copies.superminhash(b)) - 40 / 60)
    assert abs(np.mean(err)) < 0.012
    assert np.std(err) < 0.9 * np.sqrt(40 / 60 * 20 / 60 / near_copies.SLOTS)


def test_word_hashes_cut_long_words_nowhere(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(textkit, "_SEGMENT", 64)
    texts = ["a" * 500 + " b", None, "x y z " * 40, "", "end" + "é" * 100]
    h, off = textkit.word_hashes(pa.array(texts))
    monkeypatch.setattr(textkit, "_SEGMENT", 1 << 20)
    g, off2 = textkit.word_hashes(pa.array(texts))
    assert h.tolist() == g.tolist() and off.tolist() == off2.tolist() == [0, 2, 2, 122, 122, 123]


def thue_morse(first: str, n: int = 10) -> str:
    """Words on which every polynomial modulo 2^64 agrees with that of their complement."""
    for _ in range(n):
        first += first.translate(str.maketrans("ab", "ba"))
    return first


def test_words_without_common_structure_stay_apart(spark):
    import pyarrow as pa

    pairs = [(thue_morse("a", n), thue_morse("b", n)) for n in range(14)]
    h, _ = textkit.word_hashes(pa.array([w for p in pairs for w in p]))
    assert len(set(h.tolist())) == 2 * len(pairs)
    docs = [(i, " ".join([w] * 3)) for i, w in enumerate(pairs[10])]
    got = near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 1)]


def test_word_hashes_tell_words_of_all_lengths_apart():
    import pyarrow as pa

    words = [("ab" * 70)[:n] for n in range(1, 140)] + [("ab" * 70)[: n - 1] + "c" for n in range(1, 140)] + ["A" * 9, "Ab", "É"]
    h, off = textkit.word_hashes(pa.array([" ".join(words)]), lower=False)
    assert off.tolist() == [0, len(words)] and len(set(h.tolist())) == len(set(words))
    low, _ = textkit.word_hashes(pa.array(["ABC É aBcDeFgHiJ"]))
    assert low.tolist() == textkit.word_hashes(pa.array(["abc É abcdefghij"]), lower=False)[0].tolist()


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, 5)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(61)}


def brute_vectors(data, least):
    unit = {}
    for i, v, label in data:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, float)
            unit[i] = (label, len(v), x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    parent, links = {i: i for i, *_ in data}, Counter()
    for i, (la, na, a) in unit.items():
        for j, (lb, nb, b) in unit.items():
            if i < j and la == lb and na == nb and a @ b >= least:
                links[i] += 1
                links[j] += 1
                x, y = i, j
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    return {i: (links[i], find(i)) for i, *_ in data}


@pytest.mark.parametrize("cell_rows", [4096, 20])
def test_close_vectors_equal_brute_force(spark, cell_rows):
    rng = np.random.default_rng(7)
    data = []
    for c in range(25):
        centre = rng.normal(size=24)
        for _ in range(12):
            data.append((len(data), (centre + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12])).tolist(), int(c % 3)))
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None], [float("inf")] + [1.0] * 23, [1e300] * 24, [1e-300] * 24, [2.0, 0.0], [4.0, 0.0]]
    data += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, data[0][1], None)]
    df = spark.createDataFrame([(i, v, la, 5) for i, v, la in data], "vec_id long, embedding array<double>, label int, n int")
    got = close_vectors.close_vectors(df, cell_rows=cell_rows).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_vectors(data, 0.98) and len(got) == len(data)


def test_windows_of_sorted_projections_equal_plain_counts():
    rng = np.random.default_rng(1)
    for n, m, k in ((1, 1, 1), (70, 5, 9), (300, 32, 40)):
        s, q = np.round(rng.normal(size=(n, m)), 1).astype(np.float32), np.round(rng.normal(size=(k, m)), 1).astype(np.float32)
        count = (np.abs(q[:, None] - s[None]) <= np.float32(0.55)).sum(axis=2)
        for least in {1, m // 2 + 1, m}:
            a, b = close_vectors.collisions(q, *close_vectors.sorted_windows(s), np.float32(0.55), least)
            assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(*[x.tolist() for x in np.nonzero(count >= least)]))


def test_recall_with_many_halvings(spark):
    """Vectors near the threshold, in cells of a hundredth of a label: links found of those that brute force finds."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(150, 64))
    x = np.concatenate([centres + rng.normal(size=centres.shape) * s for s in (0.0, 0.1, 0.14, 0.17)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in close_vectors.close_vectors(df, cell_rows=6).collect()}  # seven halvings
    assert want.sum() > 300 and all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_close_vectors_over_the_small_table(spark):
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in close_vectors.op8_close_vectors(spark, SMALL).collect()}
    assert got == brute_vectors(data, 0.98)


def test_close_vectors_keep_invalid_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 1), (1, None, 1), (1, [0.0, 0.0], 1), (1, [1.0, 0.0], None), (1, [1.0, None], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = close_vectors.close_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links = sorted((r["vec_id"] or 0, r["n_links"]) for r in got)
    assert links == [(0, 0), (1, 0), (1, 0), (1, 0), (1, 0), (1, 1), (2, 1)]


def test_close_vectors_of_an_empty_table(spark):
    assert close_vectors.close_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_collision_count_is_calibrated():
    least = close_vectors.least_collisions(32, 2.0, 1e-7)
    rng = np.random.default_rng(0)
    hits = (np.abs(rng.normal(size=(200_000, 32))) <= 2.0).sum(axis=1)
    assert 10 < least < 32 and (hits < least).mean() < 1e-4
