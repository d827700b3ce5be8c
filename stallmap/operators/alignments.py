"""Filters and blocks of alignments (flag, mapq, nh, contig, pos, cigar, md, qname; pos from 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVERSE = 16
#: Flags that must not be set, and those that must, by kind of library.
FLAGS = {"SE": (3844, 0), "PE": (3980, 67)}


def keeps_flag(reads: str = "SE") -> Column:
    bad, needed = FLAGS[reads]
    return (F.col("flag").bitwiseAND(bad) == 0) & (F.col("flag").bitwiseAND(needed) == needed)


def is_unique() -> Column:
    return (F.col("mapq") == 255) | (F.coalesce(F.col("nh"), F.lit(0)) == 1)


def five_prime_is_sound() -> Column:
    """The 5' end is an aligned base that matches the reference."""
    back = F.col("flag").bitwiseAND(REVERSE) != 0
    op = F.when(back, F.regexp_extract("cigar", "([A-Z=])$", 1)).otherwise(F.regexp_extract("cigar", r"^\d+([A-Z=])", 1))
    same = F.when(back, F.regexp_extract("md", r"(\d+)$", 1)).otherwise(F.regexp_extract("md", r"^(\d+)", 1))
    return (op == "M") & (F.regexp_replace(same, "^0+", "") != "")


def blocks(alignments: DataFrame) -> DataFrame:
    """A row for each gapless stretch of an alignment on the reference: its columns, strand, start, end, ord.

    Insertions and clips take no reference; deletions and skips end a stretch. ord counts from the 5' end."""
    parts = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    takes = lambda p: F.when(p["op"].isin("M", "=", "X", "D", "N"), p["n"]).otherwise(0)
    at = F.transform("parts", lambda p, i: F.struct(p["op"].alias("op"), p["n"].alias("n"), (F.col("pos") + F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda a, q: a + takes(q))).alias("s")))
    aligned = F.filter(at, lambda p: p["op"].isin("M", "=", "X"))
    out = alignments.withColumn("parts", parts).withColumn("aligned", aligned).drop("parts")
    out = out.select("*", F.posexplode("aligned").alias("i", "b"), F.size("aligned").alias("m"))
    back = F.col("flag").bitwiseAND(REVERSE) != 0
    return out.select(
        *alignments.columns, F.when(back, "-").otherwise("+").alias("strand"), F.col("b.s").alias("start"), (F.col("b.s") + F.col("b.n")).alias("end"),
        F.when(back, F.col("m") - F.col("i")).otherwise(F.col("i") + 1).alias("ord"),
    )
