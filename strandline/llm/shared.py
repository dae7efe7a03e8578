"""Where intermediate tables go, and the splits by id that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.tables import cut as stash

__all__ = ["SEPARATORS", "id_mod", "stash", "table"]

#: The separators of words in every operator here: space and U+0009 to U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_mod(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n
