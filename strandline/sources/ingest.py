"""Files and records from outside: documentation files, an indexer's JSON with quarantine, excerpts of byte ranges, and stored artifacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strandline.functions import text as tx
from strandline.functions.tables import cut

#: The records of an indexer's output, by the array that holds them.
TABLES = {
    "symbols": "id string, file_path string, qualified_name string, kind string, start_line int, end_line int",
    "references": "id string, source_symbol_id string, target_symbol_id string, kind string",
    "routes": "id string, methods array<string>, path string, start_line int, end_line int",
}
_REQUIRED = {"symbols": ("id", "file_path", "qualified_name", "kind"), "references": ("id", "source_symbol_id", "kind"), "routes": ("id", "path")}


def excerpt(content: Column, start: Column, end: Column, redact: bool = True) -> Column:
    """The text of the bytes from start to before end of UTF-8 content; code points that the range cuts are left out at both ends."""
    a = F.greatest(start, F.lit(0)).cast("int")
    h = F.hex(F.substring(content, a + 1, F.greatest(end.cast("int") - a, F.lit(0))))
    whole = F.regexp_replace(h, r"^(?:[89AB][0-9A-F]){1,3}", "")
    whole = F.regexp_replace(whole, r"(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$", "")
    found = F.decode(F.unhex(whole), "UTF-8")
    return tx.redact(found) if redact else found


def documentation(spark: SparkSession, folder: str, pattern: str = "*.{md,mdx,MD,MDX}", max_bytes: int = 1 << 20) -> DataFrame:
    """(path, content_hash, size, modified, text, problem) of a folder's documentation files at any depth: the path below the folder, and no text
    where the file is too large or no UTF-8 (problem says which). Only files that fit are read; Spark's reader leaves out empty files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    below = F.substr(F.col("path"), F.lit(len(base) + 2))
    small = raw.where(F.col("length") <= max_bytes).select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    large = raw.where(F.col("length") > max_bytes).select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    small = small.select("path", F.sha2("content", 256).alias("content_hash"), "size", "modified", F.when(ok, F.decode("content", "UTF-8")).alias("text"), F.when(~ok, "not_utf8").alias("problem"))
    return small.unionByName(large.withColumns({"content_hash": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "problem": F.lit("too_large")}))


@dataclass
class Indexed:
    """The accepted records by table, what was refused as (path, subject, reason, record), and counts of both as written."""

    tables: dict[str, DataFrame]
    quarantine: DataFrame


def index_output(outputs: DataFrame, max_bytes: int = 32 << 20, max_records: int = 100_000) -> Indexed:
    """Records of an indexer's outputs(path, document): each document an object with arrays symbols, references and routes.

    A document is refused whole (subject output) if it is null, too large, no JSON object, or holds more records than allowed; a record if it is no
    object of its table's schema, or lacks a required field or has lines that end before they start. Every record and every document without
    records is in exactly one place. A missing array is empty; unknown fields are ignored; of records of one id in a document all are kept.
    """
    corrupt = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    d = outputs.select("path", "document", F.from_json("document", ", ".join(f"`{t}` array<string>" for t in TABLES) + ", _bad string", corrupt).alias("j"))
    n = sum((F.coalesce(F.size(F.col(f"j.{t}")), F.lit(0)) for t in TABLES), F.lit(0))
    reason = F.when(F.col("document").isNull(), "missing").when(F.octet_length("document") > max_bytes, "too_large").when(F.col("j").isNull() | F.col("j._bad").isNotNull() | ~F.ltrim("document").startswith("{"), "corrupt").when(n > max_records, "too_many_records")
    d = cut(d.withColumn("reason", reason).withColumn("document", F.when(F.col("reason").isNotNull(), F.col("document"))), "outputs")
    refused = d.where("reason is not null").select("path", F.lit("output").alias("subject"), "reason", F.col("document").alias("record"))
    tables = {}
    for name, schema in TABLES.items():
        e = d.where("reason is null").select("path", F.explode(F.col(f"j.{name}")).alias("record"))
        e = e.withColumn("r", F.from_json("record", f"{schema}, _bad string", corrupt))
        lacking = F.lit(False)
        for f in _REQUIRED[name]:
            lacking = lacking | F.col(f"r.{f}").isNull()
        why = F.when(F.col("record").isNull() | F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.coalesce(F.ltrim("record").startswith("{"), F.lit(False)), "corrupt").when(lacking, "missing_field")
        if "start_line" in schema:
            why = why.when(F.col("r.end_line") < F.col("r.start_line"), "invalid_range")
        e = cut(e.withColumn("reason", why), name)
        tables[name] = e.where("reason is null").select("path", *[f"r.{c.strip().split()[0]}" for c in schema.split(", ")])
        refused = refused.union(e.where("reason is not null").select("path", F.lit(name), "reason", "record"))
    return Indexed(tables, refused)


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(digest, size, media_type, content) of what is stored; digests are partitions by their first two digits."""
    schema = "digest string, size bigint, media_type string, content binary, shard string"
    try:
        return spark.read.schema(schema).parquet(root).drop("shard")
    except AnalysisException:  # nothing stored yet
        return spark.createDataFrame([], schema).drop("shard")


def persist(items: DataFrame, root: str) -> int:
    """Stores items(content, media_type) by the SHA-256 of their content, each content once; how many were new. Null contents are nothing to store;
    of one content with several media types the least is kept. A second call with the same items adds nothing; a call that fails adds nothing
    that is read back twice."""
    new = items.where("content is not null").withColumn("digest", F.sha2("content", 256))
    few = new.groupBy("digest").agg(F.min("media_type").alias("media_type"), F.first("content").alias("content"))
    there = artifacts(items.sparkSession, root).select("digest")
    few = cut(few.join(there, "digest", "left_anti").select("digest", F.octet_length("content").cast("bigint").alias("size"), "media_type", "content", F.substring("digest", 1, 2).alias("shard")), "artifacts")
    n = few.count()
    if n:
        few.repartition("shard").write.mode("append").partitionBy("shard").parquet(root)
    return n


def damaged(spark: SparkSession, root: str) -> DataFrame:
    """(digest) of stored artifacts whose content is not what its digest says."""
    return artifacts(spark, root).where(F.sha2("content", 256) != F.col("digest")).select("digest")
