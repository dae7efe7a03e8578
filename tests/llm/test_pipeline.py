"""The pipeline stage by stage against plain versions over whole small tables."""

from __future__ import annotations

import inspect

import numpy as np
import public_tokenizers as public
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from strandline.llm import line_crf
from strandline.llm.shared import table
from test_models_and_tokens import check_packing
from test_rules_and_copies import brute_copies, repeat_words, WORD


def judged(docs: list[dict]) -> dict[int, bool]:
    """The rules and host verdicts in plain Python."""
    fails, hosts = {}, {}
    for d in docs:
        t = d["text"] or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        chars, symbols, dup = sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
        f = {"short": len(words) < 20, "repeats": 100 * repeat_words(words) > 30 * len(words), "symbols": 100 * symbols > 3 * chars, "dup_lines": 100 * dup > 40 * len(lines)}
        fails[d["doc_id"]] = f | {"any": any(f.values())}
        hosts.setdefault(d["source"], []).append(d["doc_id"])
    rates = {}
    for rule in ("symbols", "dup_lines", "any"):
        n = np.array([len(v) for v in hosts.values()], float)
        k = np.array([sum(fails[i][rule] for i in v) for v in hosts.values()], float)
        raw = (k + 0.5) / (n + 1)
        mean, extra = raw.mean(), raw.var(ddof=1) - (raw * (1 - raw) / n).mean()
        strength = max(1.0, mean * (1 - mean) / extra - 1) if extra > 1e-12 else max(1.0, n.mean())
        rates[rule] = dict(zip(hosts, (k + mean * strength) / (n + strength)))
    out = {}
    for host, ids in hosts.items():
        for i in ids:
            f = fails[i]
            out[i] = not (f["short"] or f["repeats"] or rates["any"][host] > 0.5 or (f["symbols"] and rates["symbols"][host] > 0.01) or (f["dup_lines"] and rates["dup_lines"][host] > 0.01))
    return out


def test_stages_in_their_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "best_fit_packing"]
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)


def test_pipeline_equals_plain_versions(spark):
    docs = table(spark, SMALL, "documents")
    everything = [r.asDict() for r in docs.collect()]
    known = line_crf.not_held_out(table(spark, SMALL, "labels"))
    model = line_crf.learn(docs, known)

    def score(t):
        x, size = line_crf.line_features(t or "")
        bad = line_crf.forward_backward(np.stack([np.zeros(len(x)), x @ model["w"]], axis=1)[None], model["move"], np.array([len(x)]))[0][0, :, 1]
        return 1 / (1 + np.exp(-np.clip(line_crf.summary(bad, size) @ model["curve"], -30, 30)))

    want = [d for d in everything if score(d["text"]) >= 0.5]
    one = corpus_pipeline.quality_classifier(spark, docs, SMALL)
    assert one.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d["doc_id"] for d in want)

    keep = judged(want)
    two = corpus_pipeline.quality_rules(spark, one, SMALL)
    want = [d for d in want if keep[d["doc_id"]]]
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(d["doc_id"] for d in want)

    groups = brute_copies([(d["doc_id"], d["text"]) for d in want], 5, 80)
    three = corpus_pipeline.near_dedup(spark, two, SMALL)
    want = [d for d in want if groups[d["doc_id"]][1] == d["doc_id"]]
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(d["doc_id"] for d in want)
    assert three.columns == list(corpus_pipeline.COLUMNS)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = {d["doc_id"]: [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0] for d in want}
    n = check_packing(corpus_pipeline.best_fit_packing(spark, three, SMALL).collect(), ids, 2048)
    assert n <= -(-sum(map(len, ids.values())) // 2048) + 1
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.agg(F.sum("length")).first()[0] == sum(map(len, ids.values()))


def test_clean_documents_stay(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    good = labels.where("quality = 1").select("doc_id")
    kept = corpus_pipeline.quality_classifier(spark, docs, sf).join(good, "doc_id").count()
    assert kept >= 0.97 * docs.join(good, "doc_id").count()


def test_odd_documents_in_every_stage(spark):
    """Nulls, empty and very long texts, repeated rows, copies, and columns with names that stages use: what stays, exactly."""
    clean = lambda k: " ".join(f"w{k}x{i}" for i in range(90)) + "."
    texts = {0: None, 1: "", 2: "word", 3: clean(3), 4: clean(3), 5: clean(5), None: clean(7), 6: "\n".join(clean(100 + i) for i in range(900))}
    rows = [(i, t, "en", f"s{i}", 1, True, 0.1) for i, t in texts.items()] + [(5, texts[5], "en", "s5", 1, True, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double")
    ids = lambda d: sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in d.collect())
    known = line_crf.not_held_out(table(spark, SMALL, "labels"))
    model = line_crf.learn(docs, known)
    one = corpus_pipeline.quality_classifier(spark, docs, SMALL)
    scores = line_crf.score_documents(docs, known).where("score >= 0.5")
    assert ids(one) == ids(scores) and one.columns == list(corpus_pipeline.COLUMNS) and (model is not None or len(ids(one)) == 9)
    two = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert ids(two) == [-1, 3, 4, 5, 5, 6] and two.columns == list(corpus_pipeline.COLUMNS)
    three = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert ids(three) == [-1, 0, 1, 2, 3, 5, 5, 6] and three.columns == list(corpus_pipeline.COLUMNS)
    pieces = corpus_pipeline.best_fit_packing(spark, docs, SMALL).collect()
    assert sorted({(-1 if r["doc_id"] is None else r["doc_id"]) for r in pieces}) == [-1, 0, 1, 2, 3, 4, 5, 6]
    assert sum(r["doc_id"] == 5 for r in pieces) >= 2 and sum(r["doc_id"] == 6 for r in pieces) > 20
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
