"""Operator 2: near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. A pass over the texts makes each document's sketch: the size and a 128-bit digest of its shingle set, and the band
   keys of its SuperMinHash signature. SuperMinHash walks a random permutation of the slots for each shingle, so slots
   share their shingles' ranks without replacement; the walk stops at the level that can no longer lower any slot.
2. Documents with equal sets collapse to the smallest id (partial minima; thousands of copies cost one row a task).
3. Representatives that share a band bucket are candidates. Each bucket is named by its member of least hash, and
   buckets of one name form one block, so the members of a group of near copies, which share most of their buckets,
   meet in a few blocks and not in one for each band. A block is dealt into parts of bounded size, and every two parts
   meet in one task: there is no cap, and no pair is ever a row.
4. In a task the full shingle sets of two parts, made again from the texts, are intersected exactly. Only a spanning
   star of each connected piece of its links leaves a task.
5. Links give components (large-star and small-star steps).

With 24 bands of 4 slots a link at similarity 0.8 shares no bucket with a chance of 3e-6.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing. Rows with a
null id link with nothing and are kept. Repeated rows share their id and so their component. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import textkit
from strandline.llm.components import connected_components, stars
from strandline.llm.shared import stash, table

BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
U = np.uint64


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a set of 64-bit elements, as float64 ranks: level + uniform draw. An empty set gives inf.

    At level j an element draws r and a position k in [j, slots), swaps places j and k of its own permutation and
    offers j + r to the slot at place j. Levels run over all elements at once; once every slot is below j + 1, no later
    level can lower one.
    """
    h = np.full(slots, np.inf)
    if not len(elements):
        return h
    perm = None
    rows = np.arange(len(elements))
    for j in range(slots):
        x = textkit.mix(elements + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        r = (x >> U(11)).astype(np.float64) * 2.0**-53
        k = j + (textkit.mix(x) % U(slots - j)).astype(np.int64)
        if j == 0:
            first, at = k, k
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                perm[rows, first] = 0
                perm[rows, 0] = first
            at = perm[rows, k]
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = at
        np.minimum.at(h, at, r + j)
        if h.max() < j + 1:
            break
    return h


def band_keys(signature: np.ndarray) -> np.ndarray:
    v = signature.view(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = textkit.mix(key ^ v[:, i]) * U(0x9E3779B97F4A7C15)
    return key.view(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.string()), ("bands", pa.list_(pa.int64()))])
#: What one side of a comparison holds at most, in documents and in shingles (or one document).
PART_DOCS, PART_SHINGLES = 1024, 1 << 19


def set_key(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def sketcher(shingle: int):
    def run(batches):
        for b in textkit.slices(batches, "text"):
            out = [[] for _ in range(3)]
            for s in textkit.shingle_sets(*textkit.word_hashes(b.column(1)), shingle):
                out[0].append(len(s))
                out[1].append(set_key(s) if len(s) else None)
                out[2].append(band_keys(superminhash(s)) if len(s) else None)
            yield pa.record_batch([b.column(0), *[pa.array(x, f.type) for x, f in zip(out, list(_SKETCH)[1:])]], schema=_SKETCH)

    return run


_MEMBER = "pivot bigint, i int, j int, side int, id bigint, shingles binary"


def dealer(shingle: int):
    """A row for each meeting of each representative, with its set; rows come with text, set_key and meetings."""

    def run(batches):
        for b in textkit.slices(batches, "text", 1 << 20):
            ids, keys, meetings = b.column(0), b.column(2).to_pylist(), b.column(3)
            for k, s in enumerate(textkit.shingle_sets(*textkit.word_hashes(b.column(1)), shingle)):
                if len(s) and set_key(s) == keys[k]:  # another row of this id may have another text
                    m = meetings[k].values
                    n = len(m)
                    yield pa.record_batch([*[m.field(f) for f in ("pivot", "i", "j", "side")], pa.array([ids[k].as_py()] * n, pa.int64()), pa.array([s.tobytes()] * n, pa.binary())], names=["pivot", "i", "j", "side", "id", "shingles"])

    return run


def linked(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): links between two lists of (id, shingle set), or within one, as spanning stars. Exact."""
    both = sorted(left if right is None else right, key=lambda x: len(x[1]))
    sizes = np.array([len(s) for _, s in both])
    ids = np.array([i for i, _ in both])
    universe, place = np.unique(np.concatenate([s for _, s in both]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(universe), bool)
    us, vs = [], []
    for a, s in left:
        n = len(s)
        lo, hi = np.searchsorted(sizes, -(-percent * n // 100)), np.searchsorted(sizes, 100 * n // percent, "right")
        if lo >= hi:
            continue
        at = np.searchsorted(universe, s)
        at = at[(at < len(universe)) & (universe[np.minimum(at, len(universe) - 1)] == s)]
        mark[at] = True
        end = starts[hi] if hi < len(starts) else len(place)
        same = np.add.reduceat(mark[place[starts[lo] : end]].astype(np.int64), starts[lo:hi] - starts[lo])
        mark[at] = False
        hit = ids[lo:hi][(100 * same >= percent * (n + sizes[lo:hi] - same)) & (ids[lo:hi] != a)]
        us.append(np.full(len(hit), a))
        vs.append(hit)
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    return stars(u, v) if len(u) else (u, v)


def meeter(percent: int):
    """Links of every meeting (pivot, i, j); the rows of one come together."""

    def run(batches):
        now, sides = None, ([], [])

        def close():
            left, right = sides
            u, v = linked(left, right if now[1] != now[2] else None, percent) if left and (right or now[1] == now[2]) else ([], [])
            left.clear()
            right.clear()
            return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for b in batches:
            names = list(zip(*[b.column(k).to_pylist() for k in range(3)]))
            ids, side, sets = b.column(4).to_pylist(), b.column(3).to_pylist(), b.column(5)
            for k, name in enumerate(names):
                if name != now:
                    if now is not None:
                        yield close()
                    now = name
                sides[side[k]].append((ids[k], np.frombuffer(sets[k].as_py(), np.uint64)))
        if now is not None:
            yield close()

    return run


def links(docs: DataFrame, shingle: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sketch with rep, component by representative) of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stash(docs.mapInArrow(sketcher(shingle), "doc_id bigint, n_shingles bigint, set_key string, bands array<bigint>"), "sketch")
    usable = sketch.where("doc_id is not null and n_shingles > 0")
    reps = stash(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands")), "reps")
    own = reps.select(F.col("rep").alias("id"), "set_key", "n", F.posexplode("bands").alias("band", "key")).select("id", "set_key", "n", F.xxhash64("band", "key").alias("bucket"))
    # one id may stand for several sets (repeated ids), so members are told apart by their set
    named = own.groupBy("bucket").agg(F.min_by(F.xxhash64("set_key"), F.xxhash64("set_key")).alias("pivot"), F.count("*").alias("g")).where("g > 1").select("bucket", "pivot")
    members = stash(own.join(named, "bucket").select("id", "set_key", "n", "pivot").distinct(), "members")
    size = members.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / PART_DOCS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    dealt = members.join(size, "pivot").withColumn("part", F.pmod(F.xxhash64("set_key"), "parts").cast("int"))

    def meeting(k):
        return F.struct(F.col("pivot"), F.least("part", k).alias("i"), F.greatest("part", k).alias("j"), (F.col("part") > k).cast("int").alias("side"))

    meetings = dealt.select("id", "set_key", F.transform(F.sequence(F.lit(0), F.col("parts") - 1), meeting).alias("meetings"))
    meetings = meetings.groupBy("id", "set_key").agg(F.flatten(F.collect_list("meetings")).alias("meetings"))  # one representative's: a few by band
    rows = docs.join(meetings, docs["doc_id"] == meetings["id"]).select("doc_id", "text", "set_key", "meetings").mapInArrow(dealer(shingle), _MEMBER)
    together = rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    found = stash(together.mapInArrow(meeter(percent), "u bigint, v bigint"), "links")
    return sketch.join(reps.select("set_key", "rep"), "set_key", "left"), connected_components(found)


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    sketch, comp = links(docs, shingle, percent)
    d = sketch.select("doc_id", "n_shingles", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    d = d.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")))
    return d.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of all documents by 4-word shingles at a similarity of 80 %."""
    return near_copies(table(spark, sf_dir, "documents"), shingle=4, percent=80)
