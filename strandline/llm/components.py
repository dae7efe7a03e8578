"""Connected components of the links that operators find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.graphs import components, stars

__all__ = ["connected_components", "stars"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges(u, v): the smallest id it reaches. Nulls and loops are no edges."""
    return components(edges.select(F.col("u").cast("bigint").alias("src"), F.col("v").cast("bigint").alias("dst")))
