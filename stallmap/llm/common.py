"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmap.storage import materialize, shared_dir

__all__ = ["WORD", "fresh", "lower_ascii", "materialize", "n_words", "shared_dir", "small", "table", "unit"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (Spark compares names without regard to case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"{name}_"
    return name


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is: then the join shuffles,
    and adaptive execution splits its hot keys. df must be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else left alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit(*cols: Column) -> Column:
    """A number strictly between 0 and 1 from a hash of the columns; the same on every run."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
