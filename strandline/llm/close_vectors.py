"""Operator 8: near-duplicate embeddings by collision-counting projections.

1. Vectors with equal labels and equal directions (normalised components, bit for bit) collapse to the smallest id
   with their number; a very common vector costs one row a task.
2. Vectors are projected on `projections` random unit directions. Two unit vectors with the least cosine asked for
   are sqrt(2 - 2 cos) apart, so their projections differ by a normal variable of sd sqrt((2 - 2 cos) / dimension); a
   collision is a difference of at most `reach` sds in a window centred on the query.
3. The first projections also sort the vectors of a label into cells: each one used halves the label at its median,
   and as many are used as bring a cell to about `cell_rows` rows. A vector is stored in its home cell and asks, as a
   query, in every cell that its window (`border` sds) touches; each ordered pair meets once at most.
4. In a cell, stored rows and queries meet in blocks. Each projection of the stored rows is sorted, and the window
   around a query is cut from that order by two binary searches; its rows are the difference of two prefixes of the
   order, kept as bitmaps. Collisions are added up over all projections bit by bit, 64 pairs a word, and the pairs that
   reach `least` are verified by cosine in double precision. `least` is calibrated: the largest count that a pair at the
   threshold misses with a chance of at most `miss`. Only sums leave a block: links by query, and a spanning star of
   each block's links, never all pairs.

Cells that one cluster fills stay large; their rows are dealt by salts into blocks of bounded size, so no task gathers
one. Verified links are exact; a link is lost with a chance of about `miss` plus 6e-5 for each halving.

Defined cases: vectors with a null label, and vectors that are null, empty or zero or have null or non-finite
components, link with nothing. Vectors of different lengths link with nothing either. Repeated rows (equal ids) are
vectors of their own, but share their id. A row with a null id has no links. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.components import connected_components, stars
from strandline.llm.shared import stash, table


def least_collisions(projections: int, reach: float, miss: float) -> int:
    """The largest count that a pair at the threshold falls short of with a chance of at most miss."""
    p = erf(reach / sqrt(2))
    chance, t = 0.0, 0
    while t < projections:
        chance += comb(projections, t) * p**t * (1 - p) ** (projections - t)
        if chance > miss:
            break
        t += 1
    return t


def directions(n: int, dim: int, seed: int = 8) -> np.ndarray:
    a = np.random.Generator(np.random.PCG64([seed, dim])).normal(size=(n, dim))
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _project(n: int):
    """id, label, dim, unit vector, projections of valid vectors; of others the id alone, so no row is lost."""

    def run(batches):
        for b in batches:
            ids, labels, vectors = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            by: dict[int, list[int]] = {}
            bad: list[int] = []
            for i, v in enumerate(vectors):
                if v and None not in v:
                    by.setdefault(len(v), []).append(i)
                else:
                    bad.append(i)
            for dim, rows in by.items():
                x = np.array([vectors[i] for i in rows], np.float64)
                with np.errstate(all="ignore"):
                    scale = np.abs(x).max(axis=1, keepdims=True)
                    ok = np.isfinite(x).all(axis=1) & (scale[:, 0] > 0)
                    x = x[ok] / scale[ok]
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                keep = [i for i, k in zip(rows, ok) if k]
                bad += [i for i, k in zip(rows, ok) if not k]
                p = (x @ directions(n, dim).T).astype(np.float32)
                yield pa.record_batch(
                    [pa.array([ids[i] for i in keep], pa.int64()), pa.array([labels[i] for i in keep], pa.string()), pa.array([dim] * len(keep), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(list(p), pa.list_(pa.float32()))],
                    names=["id", "label", "dim", "unit", "p"],
                )
            void = [pa.nulls(len(bad), t) for t in (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.float32()))]
            yield pa.record_batch([pa.array([ids[i] for i in bad], pa.int64()), *void], names=["id", "label", "dim", "unit", "p"])

    return run


_FOUND = "u bigint, v bigint, links bigint"


def sorted_windows(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stored rows' projections (rows, projections): each projection in order, and the sets of its first k rows.

    Sets are bitmaps over the rows, 64 to a word: (projections, rows + 1, words). A window from place a to place b of an
    order holds the rows by which its first b differ from its first a.
    """
    n, m = p.shape
    order = np.argsort(p, axis=0, kind="stable").T
    firsts = np.zeros((m, n + 1, -(-n // 64)), np.uint64)
    firsts[np.arange(m)[:, None], np.arange(1, n + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    np.bitwise_or.accumulate(firsts, axis=1, out=firsts)
    return np.take_along_axis(p.T, order, axis=1), firsts


def collisions(q: np.ndarray, ordered: np.ndarray, firsts: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, stored row) of the pairs that share at least `least` of the windows of `width` around the queries.

    Counts are kept by bit: plane k holds bit k of the counts of 64 pairs a word. They start at a power of two less
    `least`, so a pair that reaches `least` carries into the last plane.
    """
    n, words = len(q), firsts.shape[2]
    depth = max(1, int(len(ordered)).bit_length())
    start = (1 << depth) - least
    planes = [np.full((n, words), np.uint64(2**64 - 1) if start >> k & 1 else np.uint64(0)) for k in range(depth + 1)]
    if least <= 0:
        planes[depth][:] = np.uint64(2**64 - 1)
    for j in range(len(ordered)):
        a, b = np.searchsorted(ordered[j], q[:, j] - width, "left"), np.searchsorted(ordered[j], q[:, j] + width, "right")
        carry = firsts[j, b] ^ firsts[j, a]
        for k in range(depth):
            both = planes[k] & carry
            planes[k] ^= carry
            carry = both
        planes[depth] |= carry
    x, word = np.nonzero(planes[depth])
    bits = np.unpackbits(planes[depth][x, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, bit = np.nonzero(bits)
    return x[i], word[i] * 64 + bit


def _count(reach: float, least: int, min_cosine: float, block: int):
    """Rows (id, null, links) with links of a query in a block, and rows (u, v, 0) of spanning stars."""

    def compare(q: dict, s: dict, ordered: np.ndarray, firsts: np.ndarray):
        width = np.float32(reach * np.sqrt((2 - 2 * min_cosine) / q["x"].shape[1]) + 1e-6)
        a, b = collisions(q["p"], ordered, firsts, width, least)
        real = b < len(s["id"])
        a, b = a[real], b[real]
        hit = a[:0]
        other = a[:0]
        for k in range(0, len(a), 1 << 16):
            x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            c = np.einsum("ij,ij->i", q["x"][x], s["x"][y])
            ok = (c >= min_cosine) & (q["id"][x] != s["id"][y])
            hit, other = np.append(hit, x[ok]), np.append(other, y[ok])
        if not len(hit):
            return None
        links = np.bincount(hit, weights=s["n"][other], minlength=len(q["id"])).astype(np.int64)
        some = np.flatnonzero(links)
        u, v = stars(q["id"][hit], s["id"][other])
        ids = np.concatenate([q["id"][some], u])
        return pa.record_batch(
            [
                pa.array(ids, pa.int64()),
                pa.array(np.concatenate([np.zeros(len(some), np.int64), v]), pa.int64(), mask=np.arange(len(ids)) < len(some)),
                pa.array(np.concatenate([links[some], np.zeros(len(u), np.int64)]), pa.int64()),
            ],
            names=["u", "v", "links"],
        )

    none = pa.record_batch([pa.array([], pa.int64())] * 3, names=["u", "v", "links"])

    def run(rows: pa.Table) -> pa.Table:
        role = np.asarray(rows.column("query").to_pylist(), bool)
        dim = rows.column("dim")[0].as_py()
        t = {
            "id": np.asarray(rows.column("id"), np.int64),
            "n": np.asarray(rows.column("n"), np.float64),
            "x": np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(-1, dim),
            "p": np.asarray(rows.column("p").combine_chunks().flatten(), np.float32).reshape(len(role), -1),
        }
        q, s = {k: v[role] for k, v in t.items()}, {k: v[~role] for k, v in t.items()}
        out = [none]
        for j in range(0, len(s["id"]), 4 * block):
            some = {k: v[j : j + 4 * block] for k, v in s.items()}
            ordered, firsts = sorted_windows(some["p"])
            for i in range(0, len(q["id"]), block):
                got = compare({k: v[i : i + block] for k, v in q.items()}, some, ordered, firsts)
                if got is not None:
                    out.append(got)
        return pa.Table.from_batches(out)

    return run


def close_vectors(vectors: DataFrame, min_cosine: float = 0.98, projections: int = 32, reach: float = 2.0, border: float = 4.0, miss: float = 1e-7, cell_rows: int = 4096, block: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding, label)."""
    every = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = "id is not null and label is not null and embedding is not null"
    valid = every.where(known)
    schema = "id bigint, label string, dim int, unit binary, p array<float>"
    projected = stash(valid.mapInArrow(_project(projections), schema), "points")
    points = projected.where("unit is not null")
    reps = stash(points.groupBy("label", "unit").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("dim").alias("dim"), F.min("p").alias("p")), "directions")

    # halvings by (label, dim): a row by label at most
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("size"))
    most = projections // 2
    depth = F.least(F.lit(most), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / cell_rows)))).cast("int")
    medians = reps.groupBy("label", "dim").agg(*[F.percentile_approx(F.get("p", F.lit(j)), 0.5, 1000).alias(f"m{j}") for j in range(most)])
    splits = sizes.withColumn("depth", depth).join(medians, ["label", "dim"]).select("label", "dim", "depth", F.array(*[f"m{j}" for j in range(most)]).alias("medians"))
    d = reps.join(splits, ["label", "dim"])
    window = F.lit(border) * F.sqrt(F.lit(2 - 2 * min_cosine) / F.col("dim"))
    side = F.transform(F.slice("medians", F.lit(1), F.col("depth")), lambda m, j: F.get("p", j) - m)
    d = d.withColumn("side", side)
    home = F.transform("side", lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0")))
    asks = F.transform("side", lambda x: F.when(F.abs(x) <= window, F.array(F.lit("0"), F.lit("1"))).when(x > 0, F.array(F.lit("1"))).otherwise(F.array(F.lit("0"))))
    cells = F.aggregate(asks, F.array(F.lit("")), lambda acc, x: F.flatten(F.transform(acc, lambda a: F.transform(x, lambda b: F.concat(a, b)))))
    stored = d.select("label", "dim", "id", "n", "unit", "p", F.array_join(home, "").alias("cell"))
    # salts: a cell is stored in as many parts as keep each within cell_rows, and queries go to each part in parts
    full = stash(stored.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts")), "cells")
    stored = stored.join(full, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    slots = F.sequence(F.lit(0), F.col("parts") - 1)
    query = d.select("label", "dim", "id", "n", "unit", "p", F.explode(cells).alias("cell")).join(full, ["label", "dim", "cell"])
    query = query.withColumn("from", F.pmod(F.xxhash64(F.lit(1), "id"), "parts").cast("int")).withColumn("part", F.explode(slots))
    stored = stored.withColumn("from", F.explode(slots))
    cols = ["label", "dim", "cell", "from", "part", "id", "n", "unit", "p"]
    meet = stored.select(*cols, F.lit(False).alias("query")).union(query.select(*cols, F.lit(True).alias("query")))
    least = least_collisions(projections, reach, miss)
    found = meet.groupBy("label", "dim", "cell", "from", "part").applyInArrow(_count(reach, least, min_cosine, block), _FOUND)
    found = stash(found, "links")

    links = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("v is not null"))
    names = reps.select("label", "unit", F.col("id").alias("rep"), "n")
    labelled = points.select("id", "label", "unit").join(names, ["label", "unit"]).select("id", "rep", "n")
    labelled = labelled.join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    labelled = labelled.select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = every.where(f"not ({known})").select("id").union(projected.where("unit is null").select("id")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    d = labelled.union(rest)
    return d.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_close_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings at a cosine of 0.98."""
    return close_vectors(table(spark, sf_dir, "embeddings"))
