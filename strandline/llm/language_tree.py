"""Operator 4: language identification by hierarchical discrimination.

A text is first given a language family, then a language within it; both steps vote among one-versus-one linear support
vector machines over hashed character n-grams (1 to 3 letters, lower-cased; whatever is no letter counts as one gap).
The machines learn from a sample of labelled rows, at most `per_language` rows of each of the `max_languages` most frequent
languages and `max_rows` in all (a hash of id and text decides, at a rate set from the counts by language; a rank by language
cuts what repeated rows bring beyond that), which alone comes to the driver, as sparse counts. Languages without a known
family are halved by the main direction of their centroids until at most MEMBERS are together, so 400 languages need some
4,000 machines of 16 KB, 65 MB, which is what is broadcast at most.

Defined cases: a text that is null or has no letter is `und` with score 1. With one family, or one language in it, there is nothing to separate and it is predicted. Without
any labelled row every text is `und` with score 0. Ties go to the language that comes first in order. Repeated rows are
predicted each; an empty table gives an empty result; other columns are not read. Very long texts are counted whole, in
blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import linear_svm
from strandline.llm.shared import id_mod, table

#: Families of language codes.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "ur", "pa", "gu"),
    "celtic": ("ga", "cy", "gd", "br"),
    "baltic": ("lt", "lv"),
    "malay": ("id", "ms", "jv"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
DIM = 4096
#: Languages of no known family that are put together, at most.
MEMBERS = 12
_letters = np.zeros(0, np.uint8)


def _is_letter() -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    return _letters


def ngram_counts(text: str, block: int = 1 << 20) -> tuple[np.ndarray, bool]:
    """Hashed counts of the 1- to 3-grams of the whole text, and whether it has a letter."""
    counts, seen, table_ = np.zeros(DIM), False, _is_letter()
    text = text.lower()
    for a in range(0, max(1, len(text)), block):  # blocks overlap by the two characters that n-grams reach back
        p = np.frombuffer(text[max(0, a - 2) : a + block].encode("utf-32-le", "surrogatepass"), np.uint32)
        p = np.where(table_[p] > 0, p, 0).astype(np.uint64)
        if not p.any():
            continue
        seen = True
        p = p[np.append(True, (p[1:] > 0) | (p[:-1] > 0))]  # gaps of one
        if a == 0:
            p = np.concatenate([[np.uint64(0)], p])
        p = np.append(p, np.uint64(0)) if a + block >= len(text) else p
        x = p * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        grams = [x, (x[:-1] ^ (x[1:] << np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)]
        grams.append((grams[1][:-1] ^ (x[2:] << np.uint64(3))) * np.uint64(0x94D049BB133111EB))
        for n, g in enumerate(grams):
            counts += np.bincount(((g >> np.uint64(40)) % np.uint64(DIM)).astype(np.int64), minlength=DIM)
    return counts, seen


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, at unit length."""
    x = np.sqrt(counts)
    return x / max(1e-12, float(np.linalg.norm(x)))


def families(names: list[str], centroids: np.ndarray) -> dict[str, str]:
    """The family of each language: the known one, else a group of at most MEMBERS languages whose centroids are close."""
    out = {n: _FAMILY[n] for n in names if n in _FAMILY}
    groups = [[i for i, n in enumerate(names) if n not in _FAMILY]]
    while groups:
        g = groups.pop()
        if len(g) <= MEMBERS:
            out |= {names[i]: f"group {names[min(g)]}" for i in g}
            continue
        c = centroids[g] - centroids[g].mean(0)
        side = c @ np.linalg.svd(c, full_matrices=False)[2][0]
        order = sorted(range(len(g)), key=lambda k: (float(side[k]), g[k]))
        half = len(g) // 2
        groups += [[g[k] for k in order[:half]], [g[k] for k in order[half:]]]
    return out


def fit_tree(x: np.ndarray, langs: list[str]) -> dict:
    """The machines of the family step and of each family; each is a pair of names, weights and bias."""
    names = sorted(set(langs))
    lang = np.array(langs)
    of = families(names, np.stack([x[lang == n].mean(0) for n in names]))
    family = np.array([of[v] for v in langs])

    def machines(labels: np.ndarray, rows: np.ndarray) -> list:
        out = []
        for a, b in combinations(sorted(set(labels[rows])), 2):
            pick = rows & ((labels == a) | (labels == b))
            w, bias = linear_svm.fit(x[pick], np.where(labels[pick] == a, 1.0, -1.0))
            out.append((str(a), str(b), w.astype(np.float32), bias))
        return out

    every = np.ones(len(lang), bool)
    members = {str(f): sorted(set(lang[family == f])) for f in sorted(set(family))}
    return {"names": names, "members": members, "top": machines(family, every), "within": {f: machines(lang, family == f) for f in members}}


def _vote(names: list[str], machines: list, x: np.ndarray) -> tuple[str, float]:
    """Most votes, then largest margin, then first in order; with a squashed mean margin of the winner."""
    if len(names) == 1:
        return names[0], 1.0
    votes = {n: [0, 0.0] for n in names}
    for a, b, w, bias in machines:
        m = float(w @ x + bias)
        votes[a if m >= 0 else b][0] += 1
        votes[a][1] += m
        votes[b][1] -= m
    best = max(names, key=lambda n: (votes[n][0], votes[n][1]))
    return best, 1 / (1 + float(np.exp(-2 * votes[best][1] / (len(names) - 1))))


def predict(tree: dict, counts: np.ndarray) -> tuple[str, float]:
    x = features(counts).astype(np.float32)
    family, p = _vote(list(tree["members"]), tree["top"], x)
    lang, q = _vote(tree["members"][family], tree["within"][family], x)
    return lang, p * q


def learn(labelled: DataFrame, per_language: int = 1000, max_languages: int = 400, max_rows: int = 20_000) -> dict | None:
    """A tree from labelled(doc_id, text, lang); None without any labelled row that has a letter.

    The driver gets at most per_language rows of each of the max_languages most frequent languages (ties: the first by
    name), and at most max_rows rows in all (documented bounds).
    """
    most = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return None
    per_language = max(1, min(per_language, max_rows // len(counts)))
    rate = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(4), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def sparse(batches):
        for b in batches:
            langs, at, n, draws = [], [], [], []
            for text, lang, d in zip(b.column(0), b.column(1), b.column(2)):
                c, seen = ngram_counts(text.as_py() or "")
                if seen:
                    i = np.flatnonzero(c)
                    langs.append(lang.as_py())
                    at.append(i.astype(np.int16))
                    n.append(c[i].astype(np.float32))
                    draws.append(d.as_py())
            yield pa.record_batch({"lang": pa.array(langs, pa.string()), "at": pa.array(at, pa.list_(pa.int16())), "n": pa.array(n, pa.list_(pa.float32())), "draw": pa.array(draws, pa.float64())})

    picked = labelled.where(draw < F.try_element_at(rate, F.col("lang"))).select("text", "lang", draw.alias("draw"))
    rows = picked.mapInArrow(sparse, "lang string, at array<smallint>, n array<float>, draw double")
    first = Window.partitionBy("lang").orderBy("draw", F.xxhash64("at", "n"))  # each task keeps its first rows before the shuffle
    rows = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language).select("lang", "at", "n").toArrow()
    if not rows.num_rows:
        return None
    x = np.zeros((rows.num_rows, DIM), np.float32)
    for i, (at, n) in enumerate(zip(rows.column("at"), rows.column("n"))):
        x[i, np.asarray(at.values)] = np.asarray(n.values)
        x[i] = features(x[i])
    return fit_tree(x, rows.column("lang").to_pylist())


def identify(docs: DataFrame, labelled: DataFrame, per_language: int = 1000) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs(doc_id, text)."""
    tree = learn(labelled, per_language)
    model = docs.sparkSession.sparkContext.broadcast(tree)  # DIM weights by pair of families or of languages in one

    def run(batches):
        t = model.value
        for b in batches:
            langs, scores = [], []
            for text in b.column(1):
                c, seen = ngram_counts(text.as_py() or "")
                lang, score = ("und", 1.0) if not seen else predict(t, c) if t else ("und", 0.0)
                langs.append(lang)
                scores.append(score)
            yield pa.record_batch({"doc_id": b.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op4_language_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learns from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    learns = docs.where((id_mod("doc_id", 5) != 0) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    d = identify(docs.select("doc_id", "text"), learns)
    return d.select("doc_id", (id_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
