"""A training-data pipeline over documents: quality classifier, quality rules, near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets after it was written and read again. The
first three return the columns of documents, for the documents that stay; the last returns packed pieces.

Defined cases, for all stages: null ids, texts, languages and sources are kept as values (a null text is empty, a null source is a host of
its own); an empty table gives an empty table; columns beyond those of documents are dropped, so none can clash; a row that is
repeated exactly is judged each time. Each stage says what else holds for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import host_rules, line_crf, near_copies, sequence_packing
from strandline.llm.shared import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field finds good on the whole (score of 0.5 or more: a tie stays).

    A null or empty text is one line of no length; without labels of both kinds every score is 0.5 and all stay. A very long text is
    scored whole in one task. Repeated rows get one score, and stay or go together.
    """
    scored = line_crf.score_documents(docs, line_crf.not_held_out(table(spark, sf_dir, "labels")), carry=COLUMNS)
    return scored.where("score >= 0.5").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep.

    Null and empty texts go (fewer than 20 words). A very long text is measured whole. A rate equal to its limit does not exceed it
    (a tie stays). Repeated rows count each in their host's rates, and stay or go together.
    """
    return host_rules.apply_host_rules(docs).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), that of the smallest id.

    Rows that repeat the kept id are that document and all stay; exact copies under other ids go. Texts without words are copies of
    nothing and stay, and so do rows without an id. A very long text is a set of its shingles in one task.
    """
    kept = near_copies.near_copies(docs, shingle=5, percent=80).where("kept").select("doc_id").distinct()
    found = docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    return found.select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    Null and empty texts are one end id. Repeated rows are packed each. A text of more than 2048 tokens is cut, its first piece the short
    one; it is encoded whole in one task. Among pieces of one length (ties) the order is by id, piece and digest.
    """
    import public_tokenizers as public

    return sequence_packing.pack_documents(docs, public.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The field and the shingle hashes have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
