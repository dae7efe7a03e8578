"""Citations and request paths against plain Python."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from strandline.functions import citations as ct

BLANKS = " \t\n" + "".join(map(chr, (0xA0, 0x2003, 0x3000, 0xFEFF)))


def plain_locate(raw: str, quote: str):
    spaces = "[" + BLANKS + r"\r\v\f]"
    words = [w for w in re.split(spaces + "+", quote) if w]
    if not words:
        return None
    m = re.search(rf"(?:^|(?<={spaces}))" + f"{spaces}+".join(map(re.escape, words)) + rf"(?={spaces}|$)", raw)
    return m and m.span()


def test_places_equal_a_search_in_the_raw_text(spark):
    rng = random.Random(8)
    rows = [("", ""), ("a", ""), ("", "a"), (None, "a"), ("a", None), ("  a b ", "a b"), ("ab", "a"), ("aa a", "a"), ("x " * 30_000 + "the\n end", "the end"), ("é\n😀 z", " 😀  z")]
    for _ in range(400):
        words = [rng.choice(["a", "b", "ab", "é", "😀", "a.b"]) for _ in range(rng.randint(0, 12))]
        raw = "".join(w + "".join(rng.choice(BLANKS) for _ in range(rng.randint(1, 3))) for w in words)
        k = rng.randrange(len(words) + 1)
        rows.append((rng.choice(["", " ", "\n\n"]) + raw, " ".join(words[k : k + rng.randint(0, 3)]) if rng.random() < 0.8 else rng.choice(["b a", "ab é", "a"])))
    df = spark.createDataFrame(rows, "raw string, quote string").select("raw", "quote", ct.locate(F.col("raw"), F.col("quote")).alias("at"))
    for r in df.collect():
        want = plain_locate(r["raw"], r["quote"]) if r["raw"] is not None and r["quote"] is not None else None
        assert (r["at"] and tuple(r["at"])) == want, (r["raw"][:80] if r["raw"] else r["raw"], r["quote"])


def test_places_in_long_texts_take_one_pass(spark):
    """Twelve words repeated thousands of times before the quote stands: a normal form for each step of the search would take minutes."""
    text = F.concat(F.repeat(F.lit("a \n b+c $d \\\\E "), F.lit(5_000)), F.lit("b+c  [$d] z"), F.col("id").cast("string"))
    d = spark.range(400).select("id", text.alias("raw")).select("id", "raw", ct.locate(F.col("raw"), F.concat(F.lit("b+c [$d] z"), F.col("id").cast("string"))).alias("at"))
    began = time.time()
    bad = d.where("at is null or at.end <> length(raw) or substr(raw, at.start + 1, 5) <> 'b+c  '").count()
    assert bad == 0 and time.time() - began < 60


def claim(statement, quote=None, kind="requirement", heading="Orders", capability="order", actor=None, outcome=None):
    return (kind, statement, statement if quote is None else quote, heading, capability, actor, outcome)


def test_each_objection(spark):
    cases = [
        (claim("The user must pay the order"), []),
        (claim("order overview page"), []),  # one short phrase that the quote holds
        (claim("When paid, the order closes", kind="acceptance_criterion", outcome="order closes"), []),
        (claim("When paid, the order closes", kind="acceptance_criterion"), ["outcome_missing"]),
        (claim("order; overview"), ["no_norm"]),
        (claim("The order must ship. It does!"), ["several_sentences"]),
        (claim("The order must ship or may wait"), ["several_norms"]),
        (claim("The user can add and edit an order"), ["compound_action", "several_actions"]),
        (claim("The user must learn and set up an order"), ["several_actions"]),
        (claim("The order must be seamless"), ["promotion"]),
        (claim("The order must ship", quote="world's best: the order must ship"), ["promotion"]),
        (claim("The order must be user-friendly"), ["vague"]),
        (claim("npm run order must work"), ["setup_instruction"]),
        (claim("Email our team: the order must ship"), ["support_contact"]),
        (claim("The order must ship", heading="Guide Setup"), ["excluded_heading"]),
        (claim("The order must ship", quote="not so: the order must ship"), ["other_polarity"]),
        (claim("The order must ship", quote="an order that must ship"), ["statement_unsupported"]),
        (claim("The order must ship", capability="refund"), ["capability_unsupported"]),
        (claim("The order must ship", actor="clerk"), ["actor_unsupported"]),
        (claim("The order must ship", outcome="parcel sent"), ["outcome_unsupported"]),
        (claim("The order must ship " + "x" * 4100), ["too_long"]),
        ((None, None, None, None, None, None, None), ["no_norm", "statement_unsupported", "capability_unsupported"]),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, kind string, statement string, quote string, heading string, capability string, actor string, outcome string")
    cols = [F.coalesce(F.col("kind"), F.lit("")), *[F.col(c) for c in ("statement", "quote", "heading", "capability", "actor", "outcome")]]
    got = {r["i"]: r["o"] for r in df.select("i", ct.objections(*cols).alias("o")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def plain_path(parts):
    if not any(k == "literal" and t for k, t in parts):
        return None, False, True
    path, query, before = "", False, None
    for k, t in parts:
        t = t or ""
        if k == "literal":
            path += t.split("?")[0]
            if "?" in t:
                query = True
                break
        elif "?" in t and not (before is None or (before[0] == "literal" and before[1].endswith("/"))):
            query = True
            break
        else:
            path += "{param}"
        before = (k, t)
    segments = [s for s in path.split("/") if s]
    if not segments:
        return None, query, True
    return "/" + "/".join(segments), query, any(k == "parameter" for k, _ in parts)


def test_request_paths_equal_plain_python(spark):
    rng = random.Random(6)
    pool = [("literal", "/api/"), ("literal", "events"), ("literal", "/"), ("literal", ""), ("literal", "x?y=1"), ("literal", "?"), ("parameter", "id"), ("parameter", "qs ? '?' + qs : ''"), ("parameter", None), ("literal", None)]
    rows = [([],), ([("parameter", "id")],), ([("literal", "events/"), ("parameter", "id"), ("literal", "/stats"), ("parameter", "q ? '?' + q : ''")],), ([("literal", "a"), ("parameter", "a?b")],)]
    rows += [([rng.choice(pool) for _ in range(rng.randint(1, 6))],) for _ in range(400)]
    df = spark.createDataFrame(rows, "parts array<struct<kind:string,text:string>>").select("parts", ct.request_path(F.col("parts")).alias("p"))
    for r in df.collect():
        assert tuple(r["p"]) == plain_path([tuple(p) for p in r["parts"]]), r["parts"]


def test_places_in_documents(spark):
    from conftest import SMALL
    from strandline.plans import catalog

    got = {r["doc_id"]: r for r in catalog.queries()["citation_places"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        quote = " ".join([w for w in re.split(r"\s+", r["text"] or "") if w][4:12])
        want = plain_locate(r["text"] or "", quote)
        assert (want is None and r["doc_id"] not in got) or (got[r["doc_id"]]["start"], got[r["doc_id"]]["end"]) == want
