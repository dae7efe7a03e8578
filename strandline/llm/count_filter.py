"""Operator 6: language-model scores from a log-frequency Bloom filter.

1. One pass hashes the texts' tokens into chunks of a few MB (a written table): each chunk has its sorted vocabulary,
   its training counts, and its token sequence as indices into the vocabulary.
2. Vocabularies and counts meet by hash shard (one row by chunk and shard, so a word that is everywhere costs one number
   a chunk). Each shard sums exact training counts, answers every chunk, and reports N and V.
3. Distinct 1- and 2-grams of the training texts and their counts meet by shard in the same way, and each shard builds
   its part of the filter (a written table, build_filter): an n-gram of quantised count q (1 + floor of log base 2) is
   entered q times, as (n-gram, 1) to (n-gram, q), with `probes` hash functions each; a shard has `bits` bits for each
   entry, so about 0.5 ** probes of absent entries seem present (0.8 % as set).
4. A filter of the whole corpus grows with it, so it has no size that could be broadcast for sure. Its parts stay where
   they are, and the distinct n-grams of each chunk go to them: probing level after level until one is absent gives the
   quantised count, and a byte for each n-gram comes back. One plan for every size; nothing is gathered on the driver, and
   a task holds one part of the filter and one chunk's probes.
5. Probability of token w after h: a mixture of the bigram estimate 2^q(hw) / 2^q(h) and the unigram estimate
   (2^q(w) + 0.5) / (N + 0.5 (V + 1)), weighted by Witten-Bell-like 2^q(h) / (2^q(h) + `prior`); all counts come from
   the filter. The base score uses the exact counts of step 2.

There is a shard for each 32 chunks (64 at least), so a shard's keys stay within about 128 MB whatever the size of the
corpus. An n-gram goes by its shard and 40 more bits of its hash: one that is absent takes the name of one that is there
with a chance of about 1e-5.

Defined cases: null and empty texts are one end token. With no training rows every count is 0. A null id counts as
empty text for the split. Repeated rows are scored each; an empty table gives an empty result; other columns are not read.
A very long text is a chunk of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.tables import forget
from strandline.llm import textkit
from strandline.llm.shared import id_mod, stash, table

U = np.uint64
END = U(0x5DEECE66D2B79F31)  # stands for the end token
START = U(0x2545F4914F6CDD1D)  # stands before the first token
_CHUNK = "chunk string, docs array<bigint>, held array<boolean>, sizes array<bigint>, vocabulary binary, counts binary, tokens binary"
_RESULT = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
_PART = "shard int, chunk string, keys binary, counts binary"


def shard_bits(chunks: int) -> int:
    """Shards are a power of two: 64, or one for each 32 chunks."""
    return max(6, (max(chunks, 1) // 32).bit_length())


def _edges(keys: np.ndarray, b: int) -> list[int]:
    """Where the shards begin and end in sorted hashes."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << b, dtype=np.uint64) << U(64 - b))
    return [0, *cuts.tolist(), len(keys)]


def _local(keys: np.ndarray, b: int) -> np.ndarray:
    """The 40 bits after those that name the shard."""
    return (keys << U(b)) >> U(24)


def _pack(keys: np.ndarray) -> bytes:
    """Numbers below 2^40 in five bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = data.reshape(-1, 5)
    return wide.view("<u8").ravel()


def _pack_counts(n: np.ndarray) -> bytes:
    """Counts in a byte each; those from 255 follow in four."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u4").tobytes()


def _unpack_counts(data: np.ndarray, size: int) -> np.ndarray:
    n = data[:size].astype(np.uint64)
    n[n == 255] = np.frombuffer(data[size:].tobytes(), "<u4")
    return n


def _chunks(limit: int):
    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for b in textkit.slices(batches, "text", limit):
            h, off = textkit.word_hashes(b.column(2))
            sizes = np.diff(off) + 1
            every = np.full(len(h) + len(sizes), END)
            ends = np.cumsum(sizes) - 1
            inner = np.ones(len(every), bool)
            inner[ends] = False
            every[inner] = h
            vocabulary, tokens = np.unique(every, return_inverse=True)
            held = np.asarray(b.column(1).to_pylist(), bool)
            train = np.repeat(~held, sizes)
            counts = np.bincount(tokens[train], minlength=len(vocabulary)).astype(np.uint32)
            row = [[f"{task}-{k}"], [b.column(0).to_pylist()], [held.tolist()], [sizes.tolist()], [vocabulary.tobytes()], [counts.tobytes()], [zstandard.compress(tokens.astype(np.uint32).tobytes(), 1)]]
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds)], names=["chunk", "docs", "held", "sizes", "vocabulary", "counts", "tokens"])
            k += 1

    return run


def _get(b: pa.RecordBatch, i: int, name: str, kind) -> np.ndarray:
    return np.frombuffer(b.column(b.schema.get_field_index(name))[i].as_buffer(), kind)


def _parts(chunk: str, keys: np.ndarray, b: int, pack, counts: np.ndarray | None = None):
    """One row by shard that has keys (sorted)."""
    edges = _edges(keys, b)
    full = [s for s in range(1 << b) if edges[s + 1] > edges[s]]
    cut = lambda x, how: pa.array([how(x[edges[s] : edges[s + 1]]) for s in full], pa.binary())
    n = pa.nulls(len(full), pa.binary()) if counts is None else cut(counts, _pack_counts)
    return pa.record_batch([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.string()), cut(keys, pack), n], names=["shard", "chunk", "keys", "counts"])


def _vocabulary_parts(bits: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield _parts(b.column(0)[i].as_py(), _get(b, i, "vocabulary", np.uint64), bits, np.ndarray.tobytes, _get(b, i, "counts", np.uint32))

    return run


def _gram_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return textkit.mix(before * U(0x9FB21C651E98DF25) ^ (after + U(0x6A09E667F3BCC909)))


class _Chunk:
    """A row of the table of chunks, and its distinct n-grams: the vocabulary, START, and pairs of neighbours."""

    def __init__(self, b: pa.RecordBatch, i: int) -> None:
        at = b.schema.get_field_index
        self.name, self.docs = b.column(0)[i].as_py(), b.column(at("docs"))[i].as_py()
        self.sizes = np.array(b.column(at("sizes"))[i].as_py())
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.vocabulary = _get(b, i, "vocabulary", np.uint64)
        self.tokens = np.frombuffer(zstandard.decompress(b.column(at("tokens"))[i].as_py()), np.uint32)
        if "counts" in b.schema.names:
            self.counts, self.held = _get(b, i, "counts", np.uint32), np.array(b.column(at("held"))[i].as_py(), bool)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = len(self.vocabulary)
        self.pairs, self.pair = np.unique(before.astype(np.uint64) << U(32) | self.tokens.astype(np.uint64), return_inverse=True)
        self.before, self.after = (self.pairs >> U(32)).astype(np.int64), (self.pairs & U(0xFFFFFFFF)).astype(np.int64)

    def keys(self) -> np.ndarray:
        words = np.append(self.vocabulary, START)
        return np.concatenate([textkit.mix(words), _gram_hash(words[self.before], words[self.after])])

    def training_counts(self) -> np.ndarray:
        """How often each of keys() occurs in training texts; START as often as there are such texts."""
        train = np.repeat(~self.held, self.sizes)
        pairs = np.bincount(self.pair[train], minlength=len(self.pairs))
        return np.concatenate([self.counts, [(~self.held).sum()], pairs]).astype(np.uint64)


def _each(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield _Chunk(b, i)


def _gram_parts(bits: int):
    """Distinct training n-grams of each chunk with their counts."""

    def run(batches):
        for c in _each(batches):
            n = c.training_counts()
            keys = c.keys()[n > 0]
            order = np.argsort(keys)
            yield _parts(c.name, keys[order], bits, lambda k: _pack(_local(k, bits)), n[n > 0][order])

    return run


def _ask_parts(bits: int):
    """All distinct n-grams of each chunk."""

    def run(batches):
        for c in _each(batches):
            yield _parts(c.name, np.sort(c.keys()), bits, lambda k: _pack(_local(k, bits)))

    return run


def _sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts).astype(np.uint64)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(n, first)


def _merge(kept: list, keys: np.ndarray, counts: np.ndarray) -> None:
    """Adds sorted runs to kept, merging runs of like size, so that a shard holds little more than its distinct keys."""
    kept.append((keys, counts.astype(np.uint64)))
    while len(kept) > 1 and len(kept[-2][0]) <= 2 * len(kept[-1][0]):
        (a, m), (b, n) = kept.pop(), kept.pop()
        kept.append(_sum_by_key([a, b], [m, n]))


def _by_shard(batches, take, close):
    """Runs take(row) for the rows of each shard, which come together, and yields what close(shard) gives."""
    now = None
    for b in batches:
        shards = b.column(0).to_pylist()
        for i in range(b.num_rows):
            if shards[i] != now:
                if now is not None:
                    yield from close(now)
                now = shards[i]
            take(b, i)
    if now is not None:
        yield from close(now)


def _answers(batches):
    """Exact totals of each chunk's part of the vocabulary, in its order; with N and V of the shard."""
    kept, asked = [], []

    def take(b, i):
        keys = _get(b, i, "keys", np.uint64)
        asked.append((b.column(1)[i].as_py(), keys))  # as many bytes as the shard has keys, which more shards keep small
        _merge(kept, keys, _unpack_counts(_get(b, i, "counts", np.uint8), len(keys)))

    def close(shard):
        k, n = _sum_by_key(*zip(*kept))
        total, distinct = int(n.sum()), int((n > 0).sum())
        for chunk, keys in asked:
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([chunk]), pa.array([n[np.searchsorted(k, keys)].tobytes()], pa.binary()), pa.array([total]), pa.array([distinct])], names=["shard", "chunk", "totals", "n", "v"])
        kept.clear()
        asked.clear()

    yield from _by_shard(batches, take, close)


def quantise(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 n) for counts from 1."""
    return np.frexp(n.astype(np.float64))[1]


def _entry(keys: np.ndarray, level: int) -> np.ndarray:
    return textkit.mix(keys + U(level * 0x9E3779B97F4A7C15 % 2**64))


def _bits(entries: np.ndarray, probe: int, size: int) -> np.ndarray:
    """Bit number of the probe-th hash function (double hashing with a cubic step, so that no step size goes in circles)."""
    a, b = entries >> U(32), (entries & U(0xFFFFFFFF)) | U(1)
    return (a + b * U(probe) + U((probe**3 - probe) // 6)) % U(size)


def _filters(bits: float, probes: int):
    def run(batches):
        kept: list = []

        def take(b, i):
            keys = _unpack(_get(b, i, "keys", np.uint8))
            _merge(kept, keys, _unpack_counts(_get(b, i, "counts", np.uint8), len(keys)))

        def close(shard):
            k, n = _sum_by_key(*zip(*kept))
            kept.clear()
            q = quantise(n)
            size = int(max(64, -(-int(bits * int(q.sum())) // 8) * 8))
            field = np.zeros(size, bool)
            for level in range(1, int(q.max()) + 1):
                e = _entry(k[q >= level], level)
                for probe in range(probes):
                    field[_bits(e, probe, size).astype(np.int64)] = True
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())], names=["shard", "size", "bits"])

        yield from _by_shard(batches, take, close)

    return run


def levels(keys: np.ndarray, size: int, field: np.ndarray, probes: int) -> np.ndarray:
    """Quantised counts of keys, 0 if absent, by probing a part of the filter until a level is absent."""
    alive, q, level = np.arange(len(keys)), np.zeros(len(keys), np.int8), 0
    while len(alive) and size:
        level += 1
        e = _entry(keys[alive], level)
        for probe in range(probes):
            at = _bits(e, probe, size)
            ok = (field[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)
            e, alive = e[ok], alive[ok]
        q[alive] = level
    return q


def _probe(probes: int):
    """Levels of each chunk's n-grams; a shard's part of the filter comes before its asks (there is none if all is absent)."""

    def run(batches):
        now, size, field = None, 0, None
        for b in batches:
            shards, chunks = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(b.num_rows):
                if shards[i] != now:
                    now, size, field = shards[i], 0, None
                if chunks[i] is None:
                    size, field = b.column(3)[i].as_py(), np.frombuffer(b.column(4)[i].as_buffer(), np.uint8)
                else:
                    q = levels(_unpack(_get(b, i, "keys", np.uint8)), size, field, probes)
                    yield pa.record_batch([pa.array([now], pa.int32()), pa.array([chunks[i]]), pa.array([q.tobytes()], pa.binary())], names=["shard", "chunk", "levels"])

    return run


def _estimate(q: np.ndarray) -> np.ndarray:
    """The middle of the counts that quantise to q, on a log scale (1 stays 1)."""
    return np.where(q <= 0, 0.0, np.where(q == 1, 1.0, 2.0 ** (q - 0.5)))


def _by_shards(df: DataFrame, bits: int, *order: str) -> DataFrame:
    return df.repartition(1 << bits, "shard").sortWithinPartitions("shard", *order)


def chunk_table(docs: DataFrame, chunk_bytes: int = 4 << 20) -> tuple[DataFrame, int]:
    """The written table of chunks of docs(doc_id, held_out, text), and the bits of its shards."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    chunks = stash(d.mapInArrow(_chunks(chunk_bytes), _CHUNK), "chunks")
    return chunks, shard_bits(chunks.count())


def build_filter(chunks: DataFrame, shards: int, bits: float = 10.0, probes: int = 7) -> DataFrame:
    """(shard, size, bits): the parts of the filter of the training n-grams of a table of chunks, written."""
    parts = chunks.mapInArrow(_gram_parts(shards), _PART)
    return stash(_by_shards(parts, shards).mapInArrow(_filters(bits, probes), "shard int, size bigint, bits binary"), "filter")


def probe_filter(chunks: DataFrame, filters: DataFrame, shards: int, probes: int = 7) -> DataFrame:
    """(shard, chunk, levels): quantised counts of the sorted n-grams of every chunk, shard by shard, written."""
    asks = chunks.mapInArrow(_ask_parts(shards), _PART).select("shard", "chunk", "keys", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("binary").alias("bits"))
    parts = filters.select("shard", F.lit(None).cast("string").alias("chunk"), F.lit(None).cast("binary").alias("keys"), "size", "bits")
    both = _by_shards(parts.union(asks), shards, "chunk")  # nulls first, so the part comes before its asks
    return stash(both.mapInArrow(_probe(probes), "shard int, chunk string, levels binary"), "levels")


def exact_totals(chunks: DataFrame, shards: int) -> DataFrame:
    """(shard, chunk, totals, n, v): training totals of the sorted vocabulary of every chunk, shard by shard, written."""
    parts = chunks.select("chunk", "vocabulary", "counts").mapInArrow(_vocabulary_parts(shards), _PART)
    return stash(_by_shards(parts, shards).mapInArrow(_answers, "shard int, chunk string, totals binary, n bigint, v bigint"), "answers")


def count_filter_scores(docs: DataFrame, chunk_bytes: int = 4 << 20, bits: float = 10.0, probes: int = 7, prior: float = 8.0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, held_out, text)."""
    spark = docs.sparkSession
    chunks, shards = chunk_table(docs, chunk_bytes)
    answers = exact_totals(chunks, shards)
    sums = answers.groupBy("shard").agg(F.max("n").alias("n"), F.max("v").alias("v")).agg(F.sum("n"), F.sum("v")).first()
    n_all, v_all = int(sums[0] or 0), int(sums[1] or 0)
    filters = build_filter(chunks, shards, bits, probes)
    forget(spark)
    found = probe_filter(chunks, filters, shards, probes)
    forget(spark)
    replies = answers.select("chunk", "shard", F.lit(0).alias("kind"), F.col("totals").alias("data")).union(found.select("chunk", "shard", F.lit(1), "levels"))
    replies = replies.groupBy("chunk").agg(F.collect_list(F.struct("kind", "shard", "data")).alias("replies"))  # two rows a shard
    d = chunks.select("chunk", "docs", "sizes", "vocabulary", "tokens").join(replies, "chunk").mapInArrow(_score(prior, n_all, v_all), _RESULT)
    return d.select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score")


def _score(prior: float, n_all: int, v_all: int):
    """Base scores from exact totals, and scores from the levels of words and pairs, of the texts of each chunk."""

    def run(batches):
        bottom = n_all + 0.5 * (v_all + 1)
        for b in batches:
            for i in range(b.num_rows):
                c = _Chunk(b, i)
                replies = sorted(b.column(b.schema.get_field_index("replies"))[i].as_py(), key=lambda r: (r["kind"], r["shard"]))
                data = lambda kind, t: np.concatenate([np.frombuffer(r["data"], t) for r in replies if r["kind"] == kind])
                totals, keys = data(0, np.uint64).astype(np.float64), c.keys()
                q = np.empty(len(keys), np.int8)
                q[np.argsort(keys)] = data(1, np.int8)
                n, q2 = _estimate(q[: len(c.vocabulary) + 1]), q[len(c.vocabulary) + 1 :]
                h, w = n[c.before], n[c.after]
                share = h / (h + prior)
                follow = np.minimum(_estimate(q2), h) / np.maximum(h, 1.0)
                p = share * follow + (1 - share) * (w + 0.5) / bottom
                add = lambda x: np.add.reduceat(x, c.starts)
                yield pa.record_batch(
                    [
                        pa.array(c.docs, pa.int64()), pa.array(c.sizes, pa.int64()), pa.array(add((totals > 0)[c.tokens].astype(np.int64))),
                        pa.array(add(np.log10((totals + 0.5) / bottom)[c.tokens])), pa.array(add(np.log10(np.maximum(p, 1e-300))[c.pair])),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def op6_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; learns from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (id_mod("doc_id", 5) == 1).alias("held_out"), "text")
    d = count_filter_scores(docs)
    return d.select("doc_id", (id_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
