"""Readers of text formats: FASTA, GFF3 and GTF, BED, SAM. All are plain Spark scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig (the header up to its first space), seq: a row for each record. Records are split at lines that begin with >, so a file
    of many is read in parts. Long contigs of unzipped files are better read by sources.fasta.tiles."""
    records = spark.read.option("lineSep", "\n>").text(path)
    # The first record of a file still has its mark.
    records = records.select(F.regexp_replace("value", r"\A\s*>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\n", 2)
    return records.select(F.regexp_extract(parts[0], r"^\s*(\S*)", 1).alias("contig"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def gff_lines(spark: SparkSession, path: str, contigs: list[str] | None = None) -> DataFrame:
    """value: the lines of features, of the named contigs only. Which contig a line is on is told from its start, so lines of others
    are never split. Files may be zipped, also in several members."""
    lines = spark.read.text(path).where("value != '' and not startswith(value, '#')")
    return lines if contigs is None else lines.where(F.substring_index("value", "\t", 1).isin(contigs))


def gff(spark: SparkSession, path: str, contigs: list[str] | None = None) -> DataFrame:
    """contig, type, start (from 0), end, strand, attrs (a map; of GFF3 or of GTF, told apart by each row)."""
    f = F.split("value", "\t")
    field = lambda i, kind="string": F.nullif(F.get(f, F.lit(i)), F.lit("")).try_cast(kind)
    rows = gff_lines(spark, path, contigs).select(field(0).alias("contig"), field(2).alias("type"), field(3, "int").alias("s"), field(4, "int").alias("e"), field(6).alias("strand"), field(8).alias("attr"))
    rows = rows.where("contig is not null and s is not null")
    pairs = F.regexp_extract_all("attr", F.lit(r'\s*([^=;\s]+)[=\s]"?[^";]*"?'), F.lit(0))
    one = lambda x: F.struct(F.regexp_extract(x, r"^\s*([^=;\s]+)", 1).alias("k"), F.regexp_extract(x, r'^\s*[^=;\s]+[=\s]"?([^";]*)', 1).alias("v"))
    # The first of repeated keys counts.
    first = F.aggregate(F.transform(pairs, one), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
    return rows.select("contig", "type", (F.col("s") - 1).alias("start"), F.col("e").alias("end"), "strand", first.alias("attrs"))


def bed_of(lines: DataFrame, line: str = "value") -> DataFrame:
    """contig, start, end, strand, of lines of six fields."""
    f = F.split(line, "\t")
    return lines.select(f[0].alias("contig"), f[1].cast("int").alias("start"), f[2].cast("int").alias("end"), F.get(f, F.lit(5)).alias("strand"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end, strand."""
    return bed_of(spark.read.text(path).where("value != '' and not startswith(value, '#')"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, mapq, nh, contig, pos (from 0), cigar, md."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.length("value") > 0))
    f = F.split("value", "\t")
    # A later filter may be evaluated before the one above, on header lines: nothing here fails on them.
    at = lambda i: F.get(f, F.lit(i))
    tag = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return lines.select(
        at(0).alias("qname"), at(1).try_cast("int").alias("flag"), at(4).try_cast("int").alias("mapq"), tag(r"\tNH:i:(\d+)").try_cast("int").alias("nh"),
        at(2).alias("contig"), (at(3).try_cast("int") - 1).alias("pos"), at(5).alias("cigar"), tag(r"\tMD:Z:(\S+)").alias("md"),
    )
