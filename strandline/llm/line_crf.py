"""Operator 3: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from features of itself and of its neighbours; forward-backward gives the marginal
chance that a line is bad, and the marginals, weighted by the lines' lengths, aggregate into the document's score (a
logistic curve over the weighted mean, its square root and the largest marginal, fitted to the labels).

The field learns from labelled documents only, at most `max_docs` of them with at most `max_lines` lines each (documented
bounds; the smallest hashes of their ids, so any input of the same rows gives the same sample). Lines inherit their document's label in the first
round; in the second, lines of bad documents that the field finds clean count as good, for a bad document need not be
bad throughout. Inputs of a score are texts alone.

Defined cases: a null or empty text is one line of length zero, scored like any other. Without labels of both kinds
every score is 0.5. Repeated rows are scored each. An empty table gives an empty result; other columns are not read. A
very long text is scored whole, in one task that holds its lines: some 500 bytes a line with their features (164), marginals
(24) and the lines themselves. A score of 0.5 (a tie) is predicted as label 1; of sampled rows with equal hashes the first by
label and features count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import id_mod, table

_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~=_+@]")
_MARK = re.compile(r"[!?]")
_DIGIT = re.compile(r"[0-9]")
OWN = 13


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) of a text, with the previous and next lines' own features beside each line's; and line lengths."""
    lines = text.split("\n")
    seen: dict[str, int] = {}
    own = np.zeros((len(lines), OWN), np.float32)
    size = np.zeros(len(lines), np.float32)
    for i, x in enumerate(lines):
        n = len(x)
        size[i] = n
        words = x.split()
        k = len(words)
        d = max(1, n)
        distinct = len(set(words))
        last = x.rstrip()[-1:]
        up = sum(map(str.isupper, words))
        own[i] = (
            1.0,
            min(1.0, 5 * len(_SYMBOL.findall(x)) / d),
            min(1.0, 5 * len(_MARK.findall(x)) / d),
            min(1.0, 3 * len(_DIGIT.findall(x)) / d),
            up / max(1, k),
            min(1.0, 20 * x.count("|") / d),
            1.0 if x in seen and k else 0.0,
            1 - distinct / max(1, k),
            sum(map(str.__eq__, words, words[1:])) / max(1, k),
            1.0 if last in ".!?:;\"')»”" and last else 0.0,
            np.log1p(k) / 6,
            1.0 if k < 3 else 0.0,
            min(1.0, (n - sum(map(len, words))) / d * 2),
        )
        seen[x] = i
    wide = np.zeros((len(lines), 3 * OWN + 2), np.float32)
    wide[:, :OWN] = own
    wide[1:, OWN : 2 * OWN] = own[:-1]
    wide[:-1, 2 * OWN : 3 * OWN] = own[1:]
    wide[0, 3 * OWN] = wide[-1, 3 * OWN + 1] = 1.0
    return wide, size


def forward_backward(unary: np.ndarray, move: np.ndarray, lengths: np.ndarray, pairs: bool = False):
    """Marginals of (docs, lines, 2) scores by document; lengths: lines of each, in descending order.

    Also log partition sums, and expected counts of moves if asked. Documents run side by side, a line at a time.
    """
    n, most, _ = unary.shape
    alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(most)]  # documents longer than t
    alpha[:, 0] = unary[:, 0]
    add = np.logaddexp
    for t in range(1, most):
        a = alpha[: alive[t], t - 1]
        for s in (0, 1):
            alpha[: alive[t], t, s] = add(a[:, 0] + move[0, s], a[:, 1] + move[1, s]) + unary[: alive[t], t, s]
    for t in range(most - 2, -1, -1):
        b = beta[: alive[t + 1], t + 1] + unary[: alive[t + 1], t + 1]
        for s in (0, 1):
            beta[: alive[t + 1], t, s] = add(move[s, 0] + b[:, 0], move[s, 1] + b[:, 1])
    end = alpha[np.arange(n), lengths - 1]
    z = add(end[:, 0], end[:, 1])
    p = np.exp(alpha + beta - z[:, None, None])
    if not pairs:
        return p, z
    expected = np.zeros((2, 2))
    for t in range(1, most):
        m = alive[t]
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] += np.exp(alpha[:m, t - 1, a] + move[a, b] + unary[:m, t, b] + beta[:m, t, b] - z[:m]).sum()
    return p, z, expected


def fit_field(docs: list[np.ndarray], labels: list[np.ndarray], steps: int = 60, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the bad state and the move scores, by Adam on the mean log-likelihood of line labels (0 good, 1 bad)."""
    groups = []
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    a = 0
    while a < len(order):  # documents of like length together, 200,000 lines at most or one document
        pick = order[a : a + max(1, min(256, 200_000 // len(docs[order[a]])))]
        a += len(pick)
        lengths = np.array([len(docs[i]) for i in pick])
        x = np.zeros((len(pick), lengths[0], docs[0].shape[1]), np.float32)
        y = np.full((len(pick), lengths[0]), -1)
        for k, i in enumerate(pick):
            x[k, : lengths[k]], y[k, : lengths[k]] = docs[i], labels[i]
        groups.append((x, y, lengths))
    total = sum(len(d) for d in docs)
    bad = sum(float((y == 1).sum()) for _, y, _ in groups)
    w, move = np.zeros(docs[0].shape[1]), np.zeros((2, 2))
    m1, m2, v1, v2 = np.zeros_like(w), np.zeros_like(move), np.zeros_like(w), np.zeros_like(move)
    w[0] = np.log(max(bad, 1) / max(total - bad, 1))
    for step in range(1, steps + 1):
        gw, gm = l2 * total * w, l2 * total * move
        for x, y, lengths in groups:
            unary = np.zeros((*y.shape, 2))
            unary[..., 1] = x @ w
            p, _, expected = forward_backward(unary, move, lengths, pairs=True)
            off = np.where(y >= 0, p[..., 1] - (y == 1), 0.0)
            gw += np.tensordot(off, x, 2)
            gm += expected
            for a in (0, 1):
                for b in (0, 1):
                    gm[a, b] -= np.count_nonzero((y[:, :-1] == a) & (y[:, 1:] == b))
        for t, g, m, v in ((w, gw / total, m1, v1), (move, gm / total, m2, v2)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            t -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, move


def bad_marginals(x: np.ndarray, w: np.ndarray, move: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """The chance of each line to be bad, for one document, a block of lines at a time: 24 bytes a line beside x."""
    n = len(x)
    e = np.empty(n)
    for a in range(0, n, block):
        e[a : a + block] = x[a : a + block] @ w
    if n == 1:
        return 1 / (1 + np.exp(-e))
    # one document: scaled products of 2 x 2 matrices in plain floats are faster than arrays
    np.exp(np.clip(e, -50, 50, out=e), out=e)
    (m00, m01), (m10, m11) = np.exp(move).tolist()
    bad, out = np.empty(n), np.empty(n)  # of the lines up to each: the share of the bad state
    first = float(e[0])
    good_now, bad_now = 1 / (1 + first), first / (1 + first)
    for a in range(0, n, block):
        part = []
        for v in e[a : a + block].tolist():
            if a or part:
                g, h = good_now * m00 + bad_now * m10, (good_now * m01 + bad_now * m11) * v
                good_now, bad_now = g / (g + h), h / (g + h)
            part.append(bad_now)
        bad[a : a + block] = part
    c, d = 1.0, 1.0
    for a in reversed(range(0, n, block)):
        part = []
        for q, v in zip(bad[a : a + block][::-1].tolist(), e[a : a + block][::-1].tolist()):
            part.append(q * d / ((1 - q) * c + q * d))
            c, d = m00 * c + m01 * v * d, m10 * c + m11 * v * d
            total = c + d
            c, d = c / total, d / total
        out[a : a + block] = part[::-1]
    return out


def summary(bad: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What a document's score depends on: bias, length-weighted mean of the marginals, its square root, largest marginal."""
    weight = size + 1.0
    mean = float(bad @ weight / weight.sum())
    return np.array([1.0, mean, np.sqrt(mean), float(bad.max())])


def fit_curve(s: np.ndarray, good: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge, classes as they are."""
    w = np.zeros(s.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(s @ w, -30, 30)))
        g = s.T @ (p - good) + 0.05 * w
        h = (s * (p * (1 - p))[:, None]).T @ s + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def learn(docs: DataFrame, known: DataFrame, max_docs: int = 2000, max_lines: int = 1000, seed: int = 3) -> dict | None:
    """The field and the curve from the texts of docs(doc_id, text) and known(doc_id, quality).

    The driver gets at most max_docs texts of at most max_lines lines each; longer texts are scored, but not learned from.
    """
    known = known.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("good"))
    draw = F.xxhash64(F.lit(seed), "doc_id")
    # the sample is drawn from ids alone; its max_docs rows then go to the documents, where repeated ids may make more
    few = known.select("doc_id", "good", draw.alias("draw")).orderBy("draw", "doc_id", "good").limit(max_docs)
    picked = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "good", "draw")

    def run(batches):
        for b in batches:
            for text, q, r in zip(b.column(0), b.column(1), b.column(2)):
                text = text.as_py() or ""
                if text.count("\n") < max_lines:
                    x, size = line_features(text)
                    yield pa.record_batch({"x": pa.array([x.tobytes()]), "size": pa.array([size.tobytes()]), "good": pa.array([q.as_py()], pa.int32()), "draw": pa.array([r.as_py()], pa.int64())})

    rows = picked.mapInArrow(run, "x binary, size binary, good int, draw bigint").orderBy("draw", "good", "x").limit(max_docs).toArrow()
    good = np.array(rows.column("good").to_pylist(), float)
    if len(set(good.tolist())) < 2:
        return None
    docs = [np.frombuffer(x.as_py(), np.float32).reshape(-1, 3 * OWN + 2) for x in rows.column("x")]
    sizes = [np.frombuffer(x.as_py(), np.float32) for x in rows.column("size")]
    labels = [np.full(len(d), 0 if g else 1) for d, g in zip(docs, good)]
    w, move = fit_field(docs, labels)
    for i, d in enumerate(docs):
        if not good[i]:
            p = bad_marginals(d, w, np.zeros((2, 2)))
            if p.max() > 0.5:  # some line explains the label, so clean lines need not
                labels[i] = (p > 0.5).astype(int)
    w, move = fit_field(docs, labels)
    s = np.array([summary(bad_marginals(d, w, move), z) for d, z in zip(docs, sizes)])
    return {"w": w, "move": move, "curve": fit_curve(s, good)}


def score_documents(docs: DataFrame, known: DataFrame, max_docs: int = 2000, keep_lines: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, score, and bad_lines (the marginal of every line) if asked, of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, known, max_docs))  # some dozens of numbers
    n = len(carry)
    at = carry.index("text") if "text" in carry and docs.schema["text"].dataType.simpleString() == "string" else n  # texts travel once

    def run(batches):
        m = model.value
        for b in batches:
            scores, lines = [], []
            for text in b.column(at):
                if m is None:
                    scores.append(0.5)
                    lines.append(None)
                    continue
                x, size = line_features(text.as_py() or "")
                p = bad_marginals(x, m["w"], m["move"])
                scores.append(float(1 / (1 + np.exp(-np.clip(summary(p, size) @ m["curve"], -30, 30)))))
                lines.append(p.tolist() if keep_lines else None)
            cols = [*b.columns[:n], pa.array(scores, pa.float64()), pa.array(lines, pa.list_(pa.float64()))]
            yield pa.record_batch(cols, names=[*carry, "score", "bad_lines"])

    d = docs.select(*carry, *([F.col("text").cast("string").alias("_text")] if at == n else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:n])
    d = d.mapInArrow(run, f"{schema}, score double, bad_lines array<double>")
    return d if keep_lines else d.drop("bad_lines")


def not_held_out(labels: DataFrame) -> DataFrame:
    return labels.where(id_mod("doc_id", 3) != 1)


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learns from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = score_documents(docs, not_held_out(table(spark, sf_dir, "labels")))
    return d.select("doc_id", (id_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
