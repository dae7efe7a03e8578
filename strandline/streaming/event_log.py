"""The event log as a stream: totals, windows with a watermark, and sequence faults against what was seen.

Each query reads a folder or file of Parquet as a stream, runs until nothing is left (availableNow) and returns its sink
as a table. Checkpoints and sinks lie in the shared folder, so a lost executor or driver continues from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.functions.tables import shared_dir


def read(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """A stream over the Parquet files of a folder, or one file."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{folder}/{name[:-1]}[{name[-1]}]")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream to its end into Parquet and returns the table. In complete mode the last batch is the result."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{place}/rows").start()
    else:
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def totals(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    e = read(spark, path, schema)
    return drain(e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "totals", "complete")


def hourly(spark: SparkSession, path: str, schema: StructType, lateness: str | None = None) -> DataFrame:
    """Windows of an hour by type.

    With a lateness, a window is written when the watermark has passed it and its state goes, so the state of an endless
    stream holds only the open windows; rows that come later, and windows still open at the end, are left out. Without one,
    the input must end: all windows are kept until then, and the table is whole.
    """
    e = read(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", lateness) if lateness else e
    w = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drain(w, "hourly", "append" if lateness else "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sequence_faults(spark: SparkSession, path: str, schema: StructType, key: str, number: str, content: str, files_per_batch: int = 64) -> DataFrame:
    """(key, number, fault) as each batch shows it: gap (the number before has not been seen), conflict (another content was
    seen for this number), replay (the same again). Rows without a number are in no sequence.

    What was seen, (key, number, content), is a table with a folder by batch; a batch that is run again replaces its own folder and reads only
    earlier ones, of the keys that came. Windows over a key compare its rows with these, so no key costs a call of its own.
    """
    rows = f"{shared_dir(spark)}/faults-{uuid.uuid4().hex}"
    s = read(spark, path, schema, files_per_batch).select(key, F.col(number).cast("bigint").alias("_n"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("_c")).where("_n is not null")
    layout = f"`{key}` {dict(s.dtypes)[key]}, _n bigint, _c string, _first boolean, fault string"
    spark.createDataFrame([], layout).write.parquet(f"{rows}/batch=-1")
    before = Window.partitionBy(key).orderBy("_n", F.desc("_old"), "_c").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(key, "_n").orderBy(F.desc("_old"), "_c")

    def step(batch: DataFrame, i: int) -> None:
        known = batch.sparkSession.read.schema(f"{layout}, batch long").parquet(rows).where((F.col("batch") < i) & F.col("_first")).select(key, "_n", "_c", F.lit(True).alias("_old"))
        known = known.join(batch.select(F.col(key).alias("_k")).distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_semi")
        d = known.union(batch.select(key, "_n", "_c", F.lit(False).alias("_old")))
        d = d.withColumn("_top", F.greatest(F.max(F.when(F.col("_old"), F.col("_n"))).over(Window.partitionBy(key)), F.max("_n").over(before)))
        d = d.withColumn("_first", F.row_number().over(same) == 1).withColumn("_seen", F.first("_c").over(same)).where("not _old")
        again = F.when(F.col("_c") == F.col("_seen"), "replay").otherwise("conflict")
        fault = F.when(~F.col("_first"), again).when(F.col("_n") > F.col("_top") + 1, "gap")
        d.select(key, "_n", "_c", "_first", fault.alias("fault")).write.mode("overwrite").option("compression", "zstd").parquet(f"{rows}/batch={i}")

    s.writeStream.option("checkpointLocation", f"{rows}-state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return spark.read.schema(layout).parquet(rows).where("fault is not null").select(key, F.col("_n").alias(number), "fault")
