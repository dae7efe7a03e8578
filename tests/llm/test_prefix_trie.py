"""Operator 13 against a trie in plain Python, and its edge cases; SQL of operators 11 to 13."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from conftest import SMALL, rows
from strandline.llm import prefix_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"


def rebuilt(data) -> dict[int, list[tuple[str, str]]]:
    own = defaultdict(list)
    for c, turn, role, text, *_ in data:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]  # SQL's remainder
    return out


def trie(convs: dict[int, list]) -> set[tuple]:
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, m in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
            leaves[path[:d]] += not kids[path]
    sha = lambda m: hashlib.sha256(",".join(map(str, sorted(m))).encode()).hexdigest()
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha([c for c in m if len(convs[c]) == len(p)])) for p, m in members.items()
    }


def found(spark, data) -> list[tuple]:
    turns, convs = prefix_trie.with_shared_heads(prefix_trie.numbered_turns(spark.createDataFrame(data, SCHEMA)))
    return [tuple(r) for r in prefix_trie.build_trie(turns, convs).collect()]


def conversation(c, texts):
    return [(c, i, "user" if i % 2 == 0 else "assistant", t, 9, "x") for i, t in enumerate(texts)]


def test_trie_equals_plain_python(spark):
    rng = random.Random(2)
    data = []
    for c in range(260):
        data += conversation(c, [rng.choice(["a", "bb", "ünï", "", "😀"]) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9]))])
    data += [(900, None, None, None, 0, ""), (900, 0, "user", "a", 0, ""), (900, 0, "user", "a", 0, ""), (901, 3, "b", "tie", 0, ""), (901, 3, "a", "tie", 0, ""), (901, 3, "a", None, 0, "")]
    data += [(None, 0, "user", "of no conversation", 0, ""), (-5, 0, "user", "a", 0, ""), (10**12 + 1, 0, "user", "a", 0, "")]
    rng.shuffle(data)
    got = found(spark, data)
    assert len(got) == len(set(got)) and set(got) == trie(rebuilt(data))


def test_long_copies_settle_at_once(spark, monkeypatch):
    """Two hundred copies of a conversation of 300 turns, and one that leaves it in turn 6, need as many levels as they share."""
    long = [f"turn {i}" for i in range(300)]
    data = [r for c in range(1000, 1200) for r in conversation(c, long)] + conversation(5000, ["x" * 2_000_000]) + conversation(5001, long[:8] + ["other"])
    steps = []
    levels = prefix_trie._levels
    monkeypatch.setattr(prefix_trie, "_levels", lambda *a: steps.append(levels(*a)) or steps[-1])
    got = found(spark, data)
    assert set(got) == trie(rebuilt(data)) and len(got) == len(set(got))
    assert len(steps[0][0]) <= 11


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    got = found(spark, conversation(c, ["only"]))  # its base has no turns, its own first turns go
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_no_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "t", 0, "")]) == []


@pytest.mark.parametrize("name", ["op11_secret_index", "op12_fill_in_middle", "op13_prefix_trie"])
def test_queries_equal_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SMALL).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
