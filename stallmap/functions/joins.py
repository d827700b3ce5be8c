"""How tables that follow the input are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame) -> DataFrame:
    """df, for a join that deals out both sides by their keys and merges them. Spark takes the size of a table that is exploded or grouped on the way
    for that of its files, and would send what it takes for small whole through the driver, however many rows it has. Adaptive
    execution still splits hot keys."""
    return df.hint("merge")
