"""Publication of a graph revision: stage, validate, activate, or roll back; and document maps replaced as a whole.

A revision is a partition of Parquet, and the log of publications says which one is current: a row (revision, publication_hash, nodes,
edges) appended last, after validation, so a reader sees the old revision or the new one whole, whatever fails in between. Publishing the same
content again is found by its hash and does nothing; a failed validation leaves no row. Two publishers that stage the same number differ in
who creates the revision's claim first: the other one gets an error and its staged rows are its own folder's (a try names its folder).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strandline.operators import rows

LOG = "revision bigint, attempt string, publication_hash string, nodes bigint, edges bigint"
MAPS = "scope string, version bigint, attempt string, map_hash string"


class InvalidPublication(ValueError):
    """The staged revision breaks a rule; nothing was activated."""


class RevisionTaken(RuntimeError):
    """Another publisher has the revision; nothing was activated."""


@dataclass(frozen=True)
class Staged:
    """A revision that is written and not current yet."""

    revision: int
    attempt: str
    publication_hash: str


def log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{root}/log")
    except AnalysisException:  # nothing published yet
        return spark.createDataFrame([], LOG)


def current(spark: SparkSession, root: str) -> int | None:
    return log(spark, root).agg(F.max("revision")).first()[0]


def _partition(root: str, table: str, revision: int, attempt: str) -> str:
    return f"{root}/{table}/graph_revision={revision}/attempt={attempt}"


def read(spark: SparkSession, root: str, table: str, revision: int | None = None) -> DataFrame:
    at = current(spark, root) if revision is None else revision
    attempt = log(spark, root).where(F.col("revision") == at).first()["attempt"]
    return spark.read.parquet(_partition(root, table, at, attempt))


def content_hash(nodes: DataFrame, edges: DataFrame) -> str:
    """The same for the same rows in any order and partitioning. Rows are hashed as JSON with their column names and nulls, so a
    value that moves to another column, or a column more, is a change."""
    row = lambda df: F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    part = lambda df: df.agg(F.count("*").alias("n"), F.sum(row(df).cast("decimal(38,0)")).alias("s")).first()
    a, b = part(nodes), part(edges)
    return f"{a['n']}:{a['s']}:{b['n']}:{b['s']}"


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, id): duplicate nodes and edges, edges without their ends, full evidence that is unreviewed."""
    return rows.violations([
        ("duplicate_node", rows.duplicates(nodes, ["id"])),
        ("duplicate_edge", rows.duplicates(edges, ["id"])),
        ("missing_from", rows.orphans(edges, "from_id", nodes, "id")),
        ("missing_to", rows.orphans(edges, "to_id", nodes, "id")),
        ("unreviewed_tier", edges.where("tier = 'C' and review_state <> 'accepted' or tier = 'D'").select("id")),
    ])


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _claim(spark: SparkSession, path: str) -> bool:
    """Creates the file if it is not there; whether this call did. One of two callers does."""
    fs, p = _fs(spark, path)
    try:
        fs.create(p, False).close()
    except Exception as e:  # noqa: BLE001
        if fs.exists(p):
            return False
        raise e
    return True


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []


def carried_over(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame, affected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with what the current revision has beside affected(id): its other nodes, and its edges between nodes that stay, of which
    neither end is affected (copy on write)."""
    old_nodes, old_edges = read(spark, root, "nodes"), read(spark, root, "edges")
    nodes = nodes.unionByName(old_nodes.join(affected, "id", "left_anti").join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)
    kept = old_edges.join(edges.select("id"), "id", "left_anti")
    for end in ("from_id", "to_id"):
        kept = kept.join(affected.select(F.col("id").alias(end)), end, "left_anti").join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges.unionByName(kept, allowMissingColumns=True)


def stage(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame, affected: DataFrame | None = None) -> Staged | None:
    """Writes nodes(id, ...) and edges(id, from_id, to_id, tier, review_state, ...) as the next revision, which no reader sees; None if the current
    revision has this content. With affected ids, the rest of the current revision is carried over."""
    at = current(spark, root)
    if affected is not None and at is not None:
        nodes, edges = carried_over(spark, root, nodes, edges, affected)
    digest = content_hash(nodes, edges)
    if at is not None and not log(spark, root).where((F.col("revision") == at) & (F.col("publication_hash") == digest)).isEmpty():
        return None
    staged = Staged((at or 0) + 1, uuid.uuid4().hex, digest)
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.parquet(_partition(root, name, staged.revision, staged.attempt))
    return staged


def activate(spark: SparkSession, root: str, staged: Staged) -> int:
    """Validates what is staged, claims its revision, and makes it current by one row of the log."""
    nodes, edges = (spark.read.parquet(_partition(root, t, staged.revision, staged.attempt)) for t in ("nodes", "edges"))
    wrong = violations(nodes, edges)
    if not wrong.isEmpty():
        raise InvalidPublication(", ".join(r["code"] for r in wrong.select("code").distinct().orderBy("code").collect()))  # codes only
    if not _claim(spark, f"{root}/claims/{staged.revision}"):
        raise RevisionTaken(str(staged.revision))
    row = (staged.revision, staged.attempt, staged.publication_hash, nodes.count(), edges.count())
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return staged.revision


def publish(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame, affected: DataFrame | None = None) -> int:
    """Stages and activates; returns the current revision afterwards."""
    staged = stage(spark, root, nodes, edges, affected)
    return current(spark, root) if staged is None else activate(spark, root, staged)


def pending(spark: SparkSession, root: str) -> DataFrame:
    """(table, revision, attempt) of staged partitions that no row of the log names."""
    found = []
    for table in ("nodes", "edges"):
        for r in _folders(spark, f"{root}/{table}"):
            found += [(table, int(r.split("=")[1]), a.split("=")[1]) for a in _folders(spark, f"{root}/{table}/{r}")]
    every = spark.createDataFrame(found, "table string, revision bigint, attempt string")
    return every.join(log(spark, root).select("revision", "attempt"), ["revision", "attempt"], "left_anti").select("table", "revision", "attempt")


def rollback(spark: SparkSession, root: str) -> int:
    """Deletes all pending partitions, and claims of revisions that never became current; how many partitions there were. Readers see no
    difference. Call it while nobody publishes."""
    rows_ = pending(spark, root).collect()
    done = {str(r["revision"]) for r in log(spark, root).select("revision").collect()}
    for r in rows_:
        fs, p = _fs(spark, _partition(root, r["table"], r["revision"], r["attempt"]))
        fs.delete(p, True)
    fs, p = _fs(spark, f"{root}/claims")
    for x in fs.listStatus(p) if fs.exists(p) else []:
        if x.getPath().getName() not in done:
            fs.delete(x.getPath(), False)
    return len(rows_)


def maps(spark: SparkSession, root: str) -> DataFrame:
    """(scope, version, attempt, map_hash): the newest version of every scope."""
    try:
        every = spark.read.schema(MAPS).parquet(f"{root}/maps")
    except AnalysisException:
        every = spark.createDataFrame([], MAPS)
    return every.groupBy("scope").agg(F.max(F.struct("version", "attempt", "map_hash")).alias("m")).select("scope", "m.*")


def replace_map(spark: SparkSession, root: str, scope: str, tables: dict[str, DataFrame]) -> int:
    """Replaces all tables of a scope's document map at once, other scopes left alone; returns its version. Equal content changes nothing.

    Each table is written whole under a folder of this try, and the pointer's row comes last: a reader that has it finds every table.
    """
    row = lambda df: F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    digest = "|".join(f"{k}:" + ":".join(map(str, df.agg(F.count(F.lit(1)), F.sum(row(df))).first())) for k, df in sorted(tables.items()))
    now = maps(spark, root).where(F.col("scope") == scope).first()
    if now is not None and now["map_hash"] == digest:
        return now["version"]
    version, attempt = (now["version"] if now else 0) + 1, uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/map-{name}/attempt={attempt}")
    if not _claim(spark, f"{root}/map-claims/{version}-{uuid.uuid5(uuid.NAMESPACE_URL, scope).hex}"):
        raise RevisionTaken(f"{scope} {version}")
    spark.createDataFrame([(scope, version, attempt, digest)], MAPS).coalesce(1).write.mode("append").parquet(f"{root}/maps")
    return version


def read_map(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table in the newest maps of all scopes, with their scope. Attempts are partitions, so others are not read."""
    at = maps(spark, root).select("scope", "attempt")
    return spark.read.parquet(f"{root}/map-{table}").join(at, "attempt").drop("attempt")


def retained(edges: DataFrame, ids: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges of an old revision that stay as history: those whose id or any evidence id is retained."""
    by_id = edges.join(ids.select("id"), "id", "left_semi")
    pairs = edges.select("id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id"), "evidence_id", "left_semi").select("id").distinct()
    by_evidence = edges.join(pairs, "id", "left_semi").join(ids.select("id"), "id", "left_anti")
    return by_id.unionByName(by_evidence).withColumn("status", F.lit("historical"))
