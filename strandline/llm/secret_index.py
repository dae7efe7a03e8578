"""Operator 11: secret scan over a trigram inverted index.

Each rule's regular expression becomes a Boolean query over trigrams that every match must hold (`trigram_query`, from the
syntax tree of Python's own parser): strings that are known exactly grow over literals, small character classes and
alternatives; what is not known ends them. Trigrams are of UTF-8 bytes with A-Z lower-cased, so a query of a rule that
ignores case is no weaker.

The index is a table of segments. A segment holds a bounded run of documents (`segment_bytes` of text, or one document):
ids, texts, and the posting lists of all trigrams of its texts. A search works out each query by uniting and intersecting the
postings of a segment and verifies only the documents that are left, with the rule itself over the whole text; a rule whose
query is empty scans every document. Nothing is shuffled, and no posting list is longer than its segment, so a trigram
that stands in every document costs no more than others. A written index answers other rules later; the query here
has one set of rules, so its segments go straight from one to the other.

Matches of one rule are leftmost and do not overlap; one whose checked group is shorter than `least` is dropped, and the
search goes on after it. Spans are in code points, ends exclusive.

Defined cases: a null text is empty and has no span; a null id is kept. Repeated rows are documents of their own. A very
long text is a segment of its own, whose trigrams are marked block by block in 16 MB whatever its length, beside the
text itself. Spans of different rules may overlap and are all given; at one start they stand in the order of the rules.
An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as sc
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.shared import table
from strandline.llm.textkit import text_bytes

#: Sets of exact strings stay below this; larger ones end there.
LIMIT = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the group that must have at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_EITHER = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)  # noqa: E731  ASCII letters in either case
RULES = (
    Rule("assign", "(" + "|".join(map(_EITHER, ("password", "passwd", "secret", "token"))) + "|" + _EITHER("api") + "_?" + _EITHER("key") + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("provider", r"gh[opsur]_[A-Za-z0-9]+|xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
BASE = 3


# Boolean queries: None holds for every text; an int is a trigram; ("and" | "or", parts).


def _conjuncts(q) -> frozenset:
    return q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset({q})


def _all(parts) -> object:
    found = frozenset().union(*[_conjuncts(q) for q in parts if q is not None])
    return None if not found else next(iter(found)) if len(found) == 1 else ("and", found)


def _any(parts) -> object:
    found = set(parts)
    if None in found or not found:
        return None
    sets = [_conjuncts(q) for q in found]
    found = {q for q in found if not any(other < _conjuncts(q) for other in sets)}  # a weaker alternative says it all
    return found.pop() if len(found) == 1 else ("or", frozenset(found))


def _of_strings(strings: set[bytes]) -> object:
    """What a text must hold that holds one of the strings."""
    return _any(_all(s[i] << 16 | s[i + 1] << 8 | s[i + 2] for i in range(len(s) - 2)) for s in strings)


@dataclass
class _Part:
    """What is known of all matches of a part of a pattern: all of them (exact), or else what they begin and end with."""

    exact: set[bytes] | None
    first: set[bytes]
    last: set[bytes]
    query: object = None

    def whole(self) -> object:
        return _of_strings(self.exact) if self.exact is not None else _all([self.query, _of_strings(self.first), _of_strings(self.last)])


def _known(strings: set[bytes]) -> _Part:
    return _Part(strings, strings, strings)


def _unknown(query: object = None) -> _Part:
    return _Part(None, {b""}, {b""}, query)


def _product(a: set[bytes], b: set[bytes]) -> set[bytes] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= LIMIT else None


def _joined(a: _Part, b: _Part) -> _Part:
    both = _product(a.last, b.first)
    if a.exact is not None and b.exact is not None and both is not None:
        return _known(both)
    first = a.first if a.exact is None else both or a.exact
    last = b.last if b.exact is None else both or b.exact
    if both is None:  # too many strings: they end here, but for the trigrams across the border
        seam = _product({s[-2:] for s in a.last}, {s[:2] for s in b.first})
        between = [_of_strings(a.last), _of_strings(b.first), _of_strings(seam) if seam else None]
    else:  # first or last has them, if either side is exact
        between = [_of_strings(both)] if a.exact is None and b.exact is None else []
    return _Part(None, first, last, _all([a.query, b.query, *between]))


#: What else matches an ASCII letter where case is ignored, besides its two forms.
_FOLDS = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def _character(code: int, ignore_case: bool) -> _Part:
    c = chr(code)
    if not ignore_case:
        return _known({c.encode(errors="surrogatepass").lower()})
    if not c.isascii():
        return _unknown()
    return _known({x.encode() for x in c.lower() + _FOLDS.get(c.lower(), "")})


def _in_class(items, ignore_case: bool) -> _Part:
    found: set[bytes] = set()
    for op, arg in items:
        if op is sc.LITERAL:
            codes = [arg]
        elif op is sc.RANGE and arg[1] - arg[0] < 2 * LIMIT:
            codes = range(arg[0], arg[1] + 1)
        else:
            return _unknown()
        for code in codes:
            one = _character(code, ignore_case)
            if one.exact is None:
                return _unknown()
            found |= one.exact
    return _known(found) if len(found) <= 16 else _unknown()


def _tree(items, ignore_case: bool) -> _Part:
    out = _known({b""})
    for op, arg in items:
        if op is sc.LITERAL:
            part = _character(arg, ignore_case)
        elif op is sc.IN:
            part = _in_class(arg, ignore_case)
        elif op is sc.SUBPATTERN:
            part = _tree(arg[3], (ignore_case or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE)
        elif op is sc.ATOMIC_GROUP:
            part = _tree(arg, ignore_case)
        elif op is sc.BRANCH:
            ways = [_tree(x, ignore_case) for x in arg[1]]
            every = set().union(*[w.exact for w in ways]) if all(w.exact is not None for w in ways) else None
            part = _known(every) if every is not None and len(every) <= LIMIT else _unknown(_any([w.whole() for w in ways]))
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT, sc.POSSESSIVE_REPEAT):
            part = _repeated(arg[0], arg[1], _tree(arg[2], ignore_case))
        elif op in (sc.AT, sc.ASSERT, sc.ASSERT_NOT):
            continue  # of no width: what stands before and after still meets
        else:
            part = _unknown()
        out = _joined(out, part)
    return out


def _repeated(least: int, most, one: _Part) -> _Part:
    if least == 0:
        return _known(one.exact | {b""}) if most == 1 and one.exact is not None and len(one.exact) < LIMIT else _unknown()
    out = one
    for _ in range(min(least, 8) - 1):
        out = _joined(out, one)
    if least == most and least <= 8:
        return out
    return _Part(None, out.first, out.last, out.query)


def trigram_query(pattern: str) -> object:
    """The Boolean query of a pattern; None if no trigram is mandatory."""
    tree = _parser.parse(pattern)
    return _tree(tree, bool(tree.state.flags & re.IGNORECASE)).whole()


def _codes(folded: np.ndarray) -> np.ndarray:
    x = folded.astype(np.int32)
    return x[:-2] << 16 | x[1:-1] << 8 | x[2:]


def _postings(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams in order, ends of their lists, rows in order) of the rows' texts."""
    if len(off) == 2:  # one text, of any length
        seen = np.zeros(1 << 24, bool) if len(raw) > _BLOCK else None
        if seen is None:
            grams = np.unique(_codes(_LOWER[raw])) if len(raw) > 2 else np.zeros(0, np.int32)
        else:
            for a in range(0, len(raw) - 2, _BLOCK):
                seen[_codes(_LOWER[raw[a : a + _BLOCK + 2]])] = True
            grams = np.flatnonzero(seen).astype(np.int32)
        return grams, np.arange(1, len(grams) + 1, dtype=np.int32), np.zeros(len(grams), np.int32)
    if len(raw) < 3:
        return (np.zeros(0, np.int32),) * 3
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off))
    inside = row[:-2] == row[2:]
    pairs = np.unique((_codes(_LOWER[raw]).astype(np.int64) << 32 | row[:-2])[inside])
    grams, first = np.unique(pairs >> 32, return_index=True)
    return grams.astype(np.int32), np.append(first[1:], len(pairs)).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)


_SEGMENT = pa.schema([("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("grams", pa.binary()), ("ends", pa.binary()), ("rows", pa.binary())])


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", segment_bytes: int = 1 << 20) -> DataFrame:
    """The segments (ids, texts, grams, ends, rows) of all documents: the last three are little-endian 32-bit numbers, the
    trigrams in order, where each one's list ends, and the lists: places of documents in the segment, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(1))
            a = 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(off, off[a] + segment_bytes, "right")) - 1)
                lists = _postings(raw[off[a] : off[z]], off[a : z + 1] - off[a])
                part = b.slice(a, z - a)
                one = [pa.array([c.to_pylist()], t) for c, t in zip(part.columns, _SEGMENT.types)]
                yield pa.record_batch([*one, *[pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in lists]], schema=_SEGMENT)
                a = z

    d = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"coalesce(cast(`{text}` as string), '') as text")
    return d.mapInArrow(run, "ids array<bigint>, texts array<string>, grams binary, ends binary, rows binary")


class _Postings:
    """The posting lists of a segment, as read."""

    def __init__(self, n: int, grams: bytes, ends: bytes, rows: bytes):
        self.n = n
        self.grams, self.ends, self.rows = (np.frombuffer(x, "<i4") for x in (grams, ends, rows))

    def of(self, gram: int) -> np.ndarray:
        i = int(np.searchsorted(self.grams, gram))
        if i == len(self.grams) or self.grams[i] != gram:
            return self.rows[:0]
        return self.rows[self.ends[i - 1] if i else 0 : self.ends[i]]

    def holding(self, query) -> np.ndarray:
        """The places of documents for which the query holds."""
        if query is None:
            return np.arange(self.n)
        if isinstance(query, int):
            return self.of(query)
        op, parts = query
        if op == "or":
            return reduce(np.union1d, map(self.holding, parts))
        found = None
        for part in sorted(parts, key=str):
            rows = self.holding(part)
            found = rows if found is None else np.intersect1d(found, rows, assume_unique=True)
            if not len(found):
                break
        return found


def matches(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    g, least = rule.group, rule.least
    return [m.span() for m in compiled.finditer(text) if m.end(g) - m.start(g) >= least]


def search_index(segments: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = BASE) -> DataFrame:
    """One row by document of the index: doc_id, a count n_<kind> by rule, base_spans (of the first `base` rules) and spans,
    each kind:start:end in order, comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = [(k, r, trigram_query(r.pattern), re.compile(r.pattern)) for k, r in enumerate(rules)]
        for b in batches:
            for i in range(b.num_rows):
                ids, texts = b.column(0)[i].values, b.column(1)[i].values
                lists = _Postings(len(ids), *[b.column(c)[i].as_py() for c in (2, 3, 4)])
                spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(ids))]
                for k, rule, query, compiled in plan:
                    for row in lists.holding(query).tolist():
                        spans[row] += [(s, k, e) for s, e in matches(texts[row].as_py(), rule, compiled)]
                counts = np.zeros((len(rules), len(ids)), np.int64)
                for row, found in enumerate(spans):
                    found.sort()
                    for _, k, _ in found:
                        counts[k, row] += 1
                said = lambda found: ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in found)
                own = pa.array([said([x for x in f if x[1] < base]) for f in spans], pa.string())
                names = ["doc_id", *[f"n_{r.kind}" for r in rules], "base_spans", "spans"]
                yield pa.record_batch([ids, *[pa.array(c) for c in counts], own, pa.array(map(said, spans), pa.string())], names)

    return segments.mapInArrow(run, ", ".join(["doc_id bigint", *[f"n_{r.kind} bigint" for r in rules], "base_spans string", "spans string"]))


def op11_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of all documents."""
    d = search_index(build_index(table(spark, sf_dir, "documents")))
    return d.selectExpr("doc_id", "n_assign", "n_access", "n_hex", "sha2(cast(base_spans as binary), 256) as base_sha256", "spans", "n_private_key", "n_provider", "n_web_token")
