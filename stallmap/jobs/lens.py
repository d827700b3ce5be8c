"""Genomic tables derived from the given tables, whole: reads from lineitem, alignments from orders, sequence from
documents, genes from part. Each has its DuckDB twin in SQL. Contigs follow the suppliers, so that depth stays and the
number of contigs grows with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "GTCAGTGAGTCAGCGATCTGAGCTAG"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores if they come in fewer parts: a table of one file is one task's."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, strand, cond (Li, K, KPDS), rep, read_id, weight, start, end, ord. Reads of K and KPDS start more often
    at some places."""
    s0 = "CAST((l_partkey * 7 + l_orderkey * 3) % 200 AS INT)"
    rows = _table(spark, sf_dir, "lineitem").selectExpr(
        "concat('c', CAST(l_suppkey AS STRING)) AS contig", "CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand",
        "CASE l_returnflag WHEN 'A' THEN 'Li' WHEN 'N' THEN 'K' ELSE 'KPDS' END AS cond", "CAST(1 + l_linenumber % 2 AS INT) AS rep",
        "l_orderkey * 10 + l_linenumber AS read_id", "CAST(1 + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS weight",
        f"{s0} AS s0", "CAST(20 + l_quantity AS INT) AS n", "l_quantity AS q",
    )
    snapped = (F.col("cond") != "Li") & (F.col("q") > 50 - F.floor(F.col("s0") / 40) * 6)
    s = F.when(snapped, F.col("s0") - F.col("s0") % 40).otherwise(F.col("s0"))
    plus = F.col("strand") == "+"
    start = F.when(plus, s).otherwise(s + 70 - F.col("n")).cast("int")
    return _spread(rows).select("contig", "strand", "cond", "rep", "read_id", "weight", start.alias("start"), (start + F.col("n")).cast("int").alias("end"), F.lit(1).alias("ord"))


BLOCKS = """
lens_reads AS (
    SELECT concat('c', CAST(l_suppkey AS VARCHAR)) AS contig, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
           CASE l_returnflag WHEN 'A' THEN 'Li' WHEN 'N' THEN 'K' ELSE 'KPDS' END AS cond, CAST(1 + l_linenumber % 2 AS INT) AS rep,
           l_orderkey * 10 + l_linenumber AS read_id, CAST(1 + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS weight,
           CAST((l_partkey * 7 + l_orderkey * 3) % 200 AS INT) AS s0, CAST(20 + l_quantity AS INT) AS n, l_quantity AS q
    FROM lineitem
), lens_snapped AS (
    SELECT *, CASE WHEN cond <> 'Li' AND q > 50 - (s0 // 40) * 6 THEN s0 - s0 % 40 ELSE s0 END AS s FROM lens_reads
), blocks AS (
    SELECT contig, strand, cond, rep, read_id, weight, CAST(CASE WHEN strand = '+' THEN s ELSE s + 70 - n END AS INT) AS st,
           CAST(CASE WHEN strand = '+' THEN s ELSE s + 70 - n END + n AS INT) AS en
    FROM lens_snapped
)"""

PILEUP = (
    BLOCKS
    + """, bases AS (
    SELECT contig, strand, cond, rep, CAST(unnest(range(st, en)) AS INT) AS pos, CASE WHEN strand = '-' THEN en - 1 ELSE st END AS rs FROM blocks
), pileup AS MATERIALIZED (
    SELECT contig, strand, cond, rep, pos, count(*) AS cov, CAST(sum(CASE WHEN rs = pos THEN 1 ELSE 0 END) AS BIGINT) AS rss
    FROM bases GROUP BY ALL
)"""
)

PAIRS = (
    PILEUP
    + """, pairs AS MATERIALIZED (
    SELECT t.contig, t.strand, t.rep, t.cond, t.pos, t.cov AS cov_t, t.rss AS rss_t, c.cov AS cov_c, c.rss AS rss_c
    FROM pileup t JOIN pileup c ON t.contig = c.contig AND t.strand = c.strand AND t.rep = c.rep AND t.pos = c.pos
    WHERE t.cond <> 'Li' AND c.cond = 'Li' AND t.cov >= 6 AND c.cov >= 6 AND (t.rss >= 1 OR c.rss >= 1)
)"""
)


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, seq: a contig for each document, its letters as bases."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return _spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("contig"), F.translate(letters, LETTERS, BASES).alias("seq"))


GENOME = f"""
genome AS (
    SELECT concat('c', CAST(doc_id AS VARCHAR)) AS contig,
           translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq
    FROM documents
)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qname, flag, mapq, nh, contig, pos, cigar, md."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "concat('q', CAST(o_orderkey div 2 AS STRING)) AS qname",
        "element_at(array(0, 16, 256, 1024, 99, 147, 2048, 83), CAST(o_orderkey % 8 AS INT) + 1) AS flag",
        "CASE WHEN o_custkey % 3 = 0 THEN 3 ELSE 255 END AS mapq", "CAST(1 + o_custkey % 2 AS INT) AS nh",
        "concat('c', CAST(o_custkey AS STRING)) AS contig", "CAST(o_orderkey % 600 AS INT) AS pos",
        "element_at(array('50M', '5S45M', '20M100N30M', '45M5S', '10M2I38M'), CAST(o_custkey % 5 AS INT) + 1) AS cigar",
        "CASE o_custkey % 7 WHEN 0 THEN '0A49' WHEN 1 THEN '49T0' WHEN 2 THEN '25C24' ELSE '50' END AS md",
    )


ALIGNMENTS = """
alignments AS (
    SELECT concat('q', CAST(o_orderkey // 2 AS VARCHAR)) AS qname,
           [0, 16, 256, 1024, 99, 147, 2048, 83][CAST(o_orderkey % 8 AS INT) + 1] AS flag,
           CASE WHEN o_custkey % 3 = 0 THEN 3 ELSE 255 END AS mapq, CAST(1 + o_custkey % 2 AS INT) AS nh,
           concat('c', CAST(o_custkey AS VARCHAR)) AS contig, CAST(o_orderkey % 600 AS INT) AS pos,
           ['50M', '5S45M', '20M100N30M', '45M5S', '10M2I38M'][CAST(o_custkey % 5 AS INT) + 1] AS cigar,
           CASE o_custkey % 7 WHEN 0 THEN '0A49' WHEN 1 THEN '49T0' WHEN 2 THEN '25C24' ELSE '50' END AS md
    FROM orders
)"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_id, gene_name, contig, strand, start, end, key."""
    return _table(spark, sf_dir, "part").selectExpr(
        "concat('g', CAST(p_partkey AS STRING)) AS gene_id", "p_brand AS gene_name", "concat('c', CAST(p_partkey div 20 + 1 AS STRING)) AS contig",
        "CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand", "CAST((p_partkey * 37) % 150 AS INT) AS start",
        "CAST((p_partkey * 37) % 150 + 300 AS INT) AS end", "p_partkey AS key",
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two a gene."""
    t = genes(spark, sf_dir).withColumn("t", F.explode(F.array(F.lit(1), F.lit(2))))
    return t.select(F.concat("gene_id", F.lit(".t"), F.col("t").cast("string")).alias("transcript_id"), "gene_id", "gene_name", "contig", "strand", (F.col("start") + 5 * F.col("t")).alias("start"), (F.col("start") + 5 * F.col("t") + 280).alias("end"), "key")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three a transcript, of 80 bases, 20 apart; e is the true number."""
    e = transcripts(spark, sf_dir).withColumn("e", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    start = F.col("start") + 100 * F.when(F.col("strand") == "+", F.col("e") - 1).otherwise(3 - F.col("e"))
    return e.select("transcript_id", "gene_id", "contig", "strand", "e", start.cast("int").alias("start"), (start + 80).cast("int").alias("end"), "key")


def cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two exons of most genes, the first one not whole."""
    rows = exons(spark, sf_dir).where("e <= 2 and key % 7 != 3")
    one = F.col("e") == 1
    return rows.select("transcript_id", "contig", "strand", F.when(one, F.col("start") + 20).otherwise(F.col("start")).alias("start"), F.when(one, F.col("start") + 60).otherwise(F.col("end")).alias("end"))


GENES = """
genes AS (
    SELECT concat('g', CAST(p_partkey AS VARCHAR)) AS gene_id, p_brand AS gene_name, concat('c', CAST(p_partkey // 20 + 1 AS VARCHAR)) AS contig,
           CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST((p_partkey * 37) % 150 AS INT) AS st,
           CAST((p_partkey * 37) % 150 + 300 AS INT) AS en, p_partkey AS key
    FROM part
), transcripts AS (
    SELECT concat(gene_id, '.t', CAST(t AS VARCHAR)) AS transcript_id, gene_id, gene_name, contig, strand,
           CAST(st + 5 * t AS INT) AS st, CAST(st + 5 * t + 280 AS INT) AS en, key
    FROM genes, (SELECT unnest([1, 2]) AS t)
), exons AS (
    SELECT transcript_id, gene_id, contig, strand, e, CAST(st + 100 * CASE WHEN strand = '+' THEN e - 1 ELSE 3 - e END AS INT) AS st,
           CAST(st + 100 * CASE WHEN strand = '+' THEN e - 1 ELSE 3 - e END + 80 AS INT) AS en, key
    FROM transcripts, (SELECT unnest([1, 2, 3]) AS e)
), cds AS (
    SELECT transcript_id, contig, strand, CASE WHEN e = 1 THEN st + 20 ELSE st END AS st, CASE WHEN e = 1 THEN st + 60 ELSE en END AS en
    FROM exons WHERE e <= 2 AND key % 7 <> 3
)"""
