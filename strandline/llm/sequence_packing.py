"""Operator 5: packing documents into sequences by a configuration linear program over the length histogram.

1. Texts become ids (a public tokenizer's file) and one end id; documents longer than a sequence are cut so that only
   the first piece may be short. Pieces go to a written table.
2. The histogram of lengths (at most `size` rows) comes to the driver. Its covering program - the fewest sequences
   whose configurations hold every length often enough - is solved by multiplicative weights: a knapsack table over the
   lengths' prices values all fillings, configurations within a share of the best price are taken as often as the counts
   allow, and lengths gain price by what was left over of them. Prices scaled to be feasible bound the number of
   sequences from below. The best pass, or the passes' mean rounded down and answered once more, is completed by priced
   fillings of what it left over. All of it works on counts by length, so the plan costs the same for any number of
   documents.
3. The plan gives each length runs of ranks: rank r of length l has its sequence and offset. Pieces get ranks within
   their length by a window over (length, salt), the salts drawn from the rows' places so that a group stays small even
   if one length, or one document, has a third of all rows.

Defined cases: null and empty texts are one end id. Repeated rows are packed each. Null ids are packed like others. An
empty table gives an empty result. Other columns are not read. A very long text is encoded whole in one task. Ties between
configurations go to the larger lengths.
"""

from __future__ import annotations

import json
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.shared import stash, table


def rank_encoding(path: str):
    """The merges of a byte-level BPE file of the tokenizers library as ranks for tiktoken; None if the file asks for more.

    Every field of the file is looked at: an unknown one, or a value that changes the ids, gives None. In such a
    vocabulary the printable bytes stand for themselves and the rest for U+0100 on, in order.
    """
    import public_tokenizers as public
    import tiktoken

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, split = d.get("model") or {}, d.get("pre_tokenizer") or {}
    plain = {"type": ("BPE",), "dropout": (None, 0.0), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "ignore_merges": (False,)}
    plain |= dict.fromkeys(("unk_token", "fuse_unk", "byte_fallback", "vocab", "merges"))  # any value: all bytes have tokens
    if any(k not in plain or (plain[k] is not None and v not in plain[k]) for k, v in model.items()) or model.get("type") != "BPE":
        return None
    if any(d.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        return None
    if any(t.get(k) for t in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocabulary, added = model["vocab"], {t["content"]: t["id"] for t in d["added_tokens"]}
    if any(c not in vocabulary for c in byte):
        return None
    ranks = {bytes([byte[c]]): vocabulary[c] for c in byte}
    for i, merge in enumerate(model["merges"]):
        token = "".join(merge if isinstance(merge, list) else merge.split(" "))
        if vocabulary.get(token) != 256 + i:  # ids must follow the order of the merges
            return None
        ranks[bytes(byte[c] for c in token)] = 256 + i
    if sorted(ranks.values()) != list(range(len(ranks))) or len(set(vocabulary) - set(added)) != len(ranks):
        return None
    return tiktoken.Encoding("file", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=added)


class Tokens:
    """Ids of texts as the tokenizers library gives them for a file, with its own settings: strings of special tokens in
    a text are those tokens, unless special_as_text.

    A file of plain byte-level BPE is encoded by tiktoken from the file's merges, with half the time; any other by the
    tokenizers library itself.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        self.fast = rank_encoding(path)
        self.allowed = set() if special_as_text else "all"
        if not self.fast:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = special_as_text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids."""
        if self.fast:
            return [np.array(self.fast.encode(t, allowed_special=self.allowed, disallowed_special=()), "<u4").tobytes() for t in texts]
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_tokens: dict[tuple[str, bool], Tokens] = {}
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def piece_table(docs: DataFrame, path: str, size: int = 2048, end: int = 0, keep_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, ids (null unless kept)."""

    def run(batches):
        if (path, special_as_text) not in _tokens:
            _tokens[path, special_as_text] = Tokens(path, special_as_text)
        tokens = _tokens[path, special_as_text]
        mark = np.array([end], np.uint32).tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            a = 0
            while a < len(ids):  # some MB of text at a time
                b, n = a, 0
                some = []
                while b < len(ids) and (not some or n < 1 << 20):
                    some.append(texts[b].as_py() or "")
                    n += len(some[-1])
                    b += 1
                rows: list[list] = [[] for _ in range(6)]
                for doc, x in zip(ids[a:b], tokens.encode(some)):
                    x += mark
                    total = len(x) // 4
                    at = 0
                    for k in range(-(-total // size)):
                        n = (total - 1) % size + 1 if k == 0 else size
                        part = x[4 * at : 4 * (at + n)]
                        for c, v in zip(rows, (doc, k, at, n, zlib.crc32(part), part if keep_ids else None)):
                            c.append(v)
                        at += n
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                a = b

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, _PIECES)


def _price(values: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Knapsack with any number of each of the lengths: the best value of every filling from 0 to size."""
    best = np.zeros(size + 1)
    upto = np.searchsorted(lengths, np.arange(size + 1), "right").tolist()
    values = values[lengths]
    for w in range(1, size + 1):
        n = upto[w]
        best[w] = max(best[w - 1], (best[w - lengths[:n]] + values[:n]).max()) if n else best[w - 1]
    return best


def _times(c: list[int], left: np.ndarray) -> int:
    return min(int(left[x]) // c.count(x) for x in set(c))


def respond(counts: np.ndarray, values: np.ndarray, size: int, eps: float, rounds: int = 6) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """Configurations within eps of the best price, largest length first, each as often as the counts allow; what is left.

    A configuration is read off the knapsack table: at every step the largest length that is still there and keeps the
    value reachable. When no more can be formed, the lengths that are left are priced again.
    """
    left, out, total = counts.copy(), [], 0
    for _ in range(rounds):
        alive = np.flatnonzero(left)
        if not len(alive):
            break
        best = _price(values, alive, size)
        least, before = best[size] * (1 - eps) - 1e-12, total
        for first in alive[::-1].tolist():
            while left[first] > 0 and values[first] + best[size - first] >= least:
                c, room, need = [first], size - first, least - values[first]
                left[first] -= 1
                while need > 1e-12 and room > 0:
                    fits = alive[: np.searchsorted(alive, room, "right")]
                    good = np.flatnonzero((best[room - fits] + values[fits] >= need - 1e-12) & (left[fits] > 0))
                    if not len(good):
                        break
                    x = int(fits[good[-1]])
                    c.append(x)
                    left[x] -= 1
                    room -= x
                    need -= values[x]
                if need > 1e-12:  # its lengths are used up
                    for x in c:
                        left[x] += 1
                    break
                more = _times(c, left)
                for x in set(c):
                    left[x] -= more * c.count(x)
                out.append((tuple(c), 1 + more))
                total += 1 + more
        if total - before < 0.02 * total + 1:
            break
    return out, left


def _fill(left: np.ndarray, values: np.ndarray, size: int, first: int) -> list[int]:
    """The best configuration with first that uses no length more often than it is left (knapsack with counts)."""
    cap = size - first
    best, taken = np.zeros(cap + 1), []
    for x in np.flatnonzero(left[: cap + 1]).tolist():
        m, k = min(int(left[x]) - (x == first), cap // x), 1
        while m > 0:
            k = min(k, m)
            m -= k
            v = best[: cap + 1 - k * x] + k * values[x]
            better = v > best[k * x :] + 1e-12
            taken.append((x, k, better))
            best[k * x :][better] = v[better]
            k *= 2
    room, c = int(best.argmax()), [first]
    for x, k, better in reversed(taken):
        if room >= k * x and better[room - k * x]:
            c += [x] * k
            room -= k * x
    return c


def complete(counts: np.ndarray, values: np.ndarray, size: int) -> list[tuple[tuple, int]]:
    """Packs all that is left: the largest length first, each with its best filling."""
    left, out = counts.copy(), []
    for first in np.flatnonzero(left)[::-1].tolist():
        while left[first] > 0:
            c = _fill(left, values, size, first)
            n = _times(c, left)
            for x in set(c):
                left[x] -= n * c.count(x)
            out.append((tuple(c), n))
    return out


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing over counts by length: (lengths of a sequence, how many such sequences)."""
    gaps: dict[int, list[tuple[tuple, int]]] = {}
    free = 0  # bitmap of gaps that have sequences

    def put(gap: int, c: tuple, n: int) -> None:
        nonlocal free
        if n:
            gaps.setdefault(gap, []).append((c, n))
            free |= 1 << gap

    for x in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[x])
        while n:
            fits = free >> x
            if fits:
                g = x + (fits & -fits).bit_length() - 1
                c, m = gaps[g].pop()
                if not gaps[g]:
                    free ^= 1 << g
            else:
                g, c, m = size, (), -(-n // (size // x))
            k = min(g // x, n)  # as many as fit: after one, this gap is still the smallest that fits
            full = min(m, n // k)
            put(g - k * x, c + (x,) * k, full)
            put(g, c, m - full) if c else None
            n -= full * k
    return [x for every in gaps.values() for x in every]


def _certain(counts: np.ndarray, size: int) -> float:
    """A lower bound on the sequences from fixed prices: for each a, lengths over size - a cost a sequence, those under a nothing."""
    x = np.arange(size + 1)
    large, mass = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * x)
    a = np.arange(size // 2 + 1)
    middle = mass[size - a] - np.where(a > 0, mass[np.maximum(a - 1, 0)], 0)
    over = np.append(large, 0)[size - a + 1]
    return float((over + middle / size).max())


def plan(counts: np.ndarray, size: int, passes: int = 48, rate: float = 0.4) -> tuple[list[tuple[tuple, int]], int]:
    """Configurations and how many sequences of each, which hold every length exactly counts times; and the dual bound.

    Multiplicative weights on the configuration program: each pass answers the prices with whole configurations near the
    best one, and lengths gain price by the share that the pass left over. The bound on the number of sequences is the
    largest value of prices scaled to be feasible. The passes' mean is a fractional solution; rounded down and answered
    once more it is one more candidate. Best-fit only ranks the candidates; what the one with the fewest sequences
    leaves over is packed by priced fillings. With many distinct lengths there are fewer passes (12 at least).
    """
    counts = counts.astype(np.int64)
    if not counts.any():
        return [], 0
    x = np.arange(size + 1)
    prices = np.where(counts > 0, x / size, 0.0)
    bound, tried, mean = _certain(counts, size), [], {}

    def judge(found, left, values):
        tried.append((sum(n for _, n in found) + sum(n for _, n in best_fit(left, size)), int(left.sum()), len(tried), found, left, values))

    done = lambda: min(tried)[0] <= ceil(bound - 1e-6)
    alive = np.flatnonzero(counts)
    passes = min(passes, max(12, 20_000 // len(alive)))
    for t in range(passes):
        bound = max(bound, float(counts @ prices) / _price(prices, alive, size)[size])
        found, left = respond(counts, prices, size, (0.0, 0.01, 0.001)[t % 3])
        judge(found, left, prices)
        if done():
            break
        for c, n in found:
            mean[c] = mean.get(c, 0) + n / passes
        prices = prices * np.exp(rate * left / np.maximum(counts, 1))
        prices /= prices.max()
    if not done():
        left, out = counts.copy(), []
        for c, share in sorted(mean.items(), key=lambda z: (-z[1], z[0])):
            n = min(int(share), _times(list(c), left))
            if n:
                out.append((c, n))
                for y in set(c):
                    left[y] -= n * c.count(y)
        found, left = respond(left, prices, size, 0.001)
        judge(out + found, left, prices)
    best = None
    for _, _, _, found, left, values in sorted(tried, key=lambda z: z[:3])[:3]:
        made = found + complete(left, x / size, size)
        if best is None or sum(n for _, n in made) < sum(n for _, n in best):
            best = made
    return best, ceil(bound - 1e-6)


def _runs(configs: list[tuple[tuple, int]], size: int) -> dict[str, np.ndarray]:
    """By length and first rank: how a rank finds its sequence and offset."""
    rows, used, base = [], np.zeros(size + 1, np.int64), 0
    for c, n in configs:
        offset = 0
        for x in sorted(set(c), reverse=True):
            a = c.count(x)
            rows.append((x, int(used[x]), base, a, offset))
            used[x] += a * n
            offset += a * x
        base += n
    rows.sort()
    t = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (t[:, 0] << 48) | t[:, 1], "rank": t[:, 1], "base": t[:, 2], "each": t[:, 3], "offset": t[:, 4]}


def pack_pieces(pieces: DataFrame, size: int = 2048, group_rows: int = 20_000) -> DataFrame:
    """pieces (a written table; place: a number of the row's own) with sequence_id and offset, without place."""
    spark = pieces.sparkSession
    counts = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most size rows
        counts[r["length"]] = r["count"]
    runs = spark.sparkContext.broadcast(_runs(plan(counts, size)[0], size))  # bounded by the configurations of the plan
    salts = spark.createDataFrame([(int(x), int(-(-counts[x] // group_rows))) for x in np.flatnonzero(counts)], "length bigint, salts bigint")
    d = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("place"), "salts")).drop("salts")
    sizes = d.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "place")
    d = d.withColumn("rank", F.row_number().over(within).cast("bigint")).join(sizes, ["length", "salt"])
    d = d.withColumn("rank", F.col("rank") - 1 + F.col("before")).select(*[c for c in pieces.columns if c != "place"], "rank")

    def place(batches):
        t = runs.value
        for b in batches:
            x = np.asarray(b.column(b.schema.get_field_index("length")), np.int64)
            r = np.asarray(b.column(b.schema.get_field_index("rank")), np.int64)
            i = np.searchsorted(t["key"], (x << 48) | r, "right") - 1
            at = r - t["rank"][i]
            cols = [*b.columns[:-1], pa.array(t["base"][i] + at // t["each"][i]), pa.array(t["offset"][i] + at % t["each"][i] * x)]
            yield pa.record_batch(cols, names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "place")
    return d.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end: int = 0, keep_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if kept, of docs(doc_id, text)."""
    pieces = piece_table(docs, path, size, end, keep_ids, special_as_text).withColumn("place", F.monotonically_increasing_id())
    return pack_pieces(stash(pieces if keep_ids else pieces.drop("ids"), "pieces"), size)


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers as public

    return pack_documents(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"))
