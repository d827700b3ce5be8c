"""Gene annotation: attributes, hierarchy, exon order, junctions, untranslated regions, overlap with sites."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmap.constants import WINDOW
from stallmap.functions import genome
from stallmap.functions.intervals import overlap_join, pieces
from stallmap.functions.joins import dealt
from stallmap.functions.sequence import reverse_complement

#: Feature types taken for transcripts.
TRANSCRIPT_TYPES = (
    "antisense_RNA", "guide_RNA", "lnc_RNA", "mRNA", "primary_transcript", "RNase_MRP_RNA", "RNase_P_RNA", "rRNA", "scRNA", "snoRNA",
    "snRNA", "telomerase_RNA", "transcript", "tRNA", "vault_RNA", "Y_RNA", "C_gene_segment", "D_gene_segment", "J_gene_segment", "V_gene_segment",
)
REFSEQ_ORDER = ("NM", "NR", "XM", "XR")
GENE_BIN = 16_384


def first_of(attrs: Column, *keys: str) -> Column:
    """The first of these attributes that is there."""
    return F.coalesce(*[F.element_at(attrs, F.lit(k)) for k in keys])


def features(gff: DataFrame) -> DataFrame:
    """Rows of a GFF3 or GTF scan with the ids that they name: kind (gene, transcript, exon, cds), contig, start, end,
    strand, feature_id, parent_id, gene_name, number. Rows with PAR_Y in the id, and of other types, go."""
    kind = (
        F.when(F.col("type").isin("gene", "pseudogene"), "gene").when(F.col("type").isin(*TRANSCRIPT_TYPES), "transcript")
        .when(F.col("type") == "exon", "exon").when(F.col("type") == "CDS", "cds")
    )
    a = F.col("attrs")
    own = F.when(F.col("kind") == "gene", first_of(a, "ID", "gene_id")).otherwise(first_of(a, "ID", "transcript_id"))
    parent = F.when(F.col("kind") == "transcript", first_of(a, "Parent", "gene_id")).when(F.col("kind") != "gene", first_of(a, "Parent", "transcript_id"))
    name = F.coalesce(first_of(a, "gene_name", "gene", "Name", "description"), F.lit(""))
    out = gff.withColumn("kind", kind).where("kind is not null")
    out = out.select("kind", "contig", "start", "end", "strand", own.alias("feature_id"), parent.alias("parent_id"), name.alias("gene_name"), F.element_at("attrs", F.lit("exon_number")).cast("int").alias("number"))
    return out.where("feature_id is null or not contains(feature_id, 'PAR_Y')")


def hierarchy(genes: DataFrame, transcripts: DataFrame, exons: DataFrame) -> DataFrame:
    """Exons with their transcript and gene. The order of the input doesn't matter."""
    return exons.join(transcripts.select("transcript_id", "gene_id"), "transcript_id").join(genes.select("gene_id", "gene_name"), "gene_id")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent isn't there."""
    return children.join(parents.select(key), key, "left_anti")


def _five_to_three(name: str = "start") -> Column:
    return F.when(F.col("strand") == "-", -F.col(name)).otherwise(F.col(name))


def numbered(exons: DataFrame, declared: str | None = None) -> DataFrame:
    """exons with number from 1, 5' to 3' within transcript_id; declared numbers hold where a transcript has them all,
    1 to n."""
    order = Window.partitionBy("transcript_id").orderBy(_five_to_three())
    counted = exons.withColumn("number_", F.row_number().over(order))
    if not declared:
        return counted.withColumnRenamed("number_", "number")
    whole = Window.partitionBy("transcript_id")
    sound = (F.count(declared).over(whole) == F.count("*").over(whole)) & (F.sort_array(F.collect_list(declared).over(whole)) == F.sequence(F.lit(1), F.count("*").over(whole).cast("int")))
    counted = counted.withColumn("sound", sound).withColumn("number_", F.when(F.col("sound"), F.col(declared)).otherwise(F.col("number_")))
    return counted.drop("sound", declared).withColumnRenamed("number_", "number")


def junctions(exons: DataFrame) -> DataFrame:
    """numbered exons -> a row for each pair of consecutive ones: transcript_id, number, and the intron's start, end."""
    order = Window.partitionBy("transcript_id").orderBy("number")
    after = F.lead(F.struct("start", "end")).over(order)
    rows = exons.withColumn("after", after).where("after is not null")
    start = F.when(F.col("strand") == "-", F.col("after.end")).otherwise(F.col("end"))
    end = F.when(F.col("strand") == "-", F.col("start")).otherwise(F.col("after.start"))
    return rows.select("transcript_id", "contig", "strand", "number", start.alias("intron_start"), end.alias("intron_end"))


def spliced(exons: DataFrame, *more: str) -> DataFrame:
    """numbered exons -> one row a transcript: transcript_id, contig, strand, further columns, and its exons in order as an
    array of (start, end)."""
    order = F.array_sort(F.collect_list(F.struct("number", "start", "end")))
    rows = exons.groupBy("transcript_id", "contig", "strand", *more).agg(order.alias("exons"))
    return rows.withColumn("exons", F.transform("exons", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))


def junction_windows(exons: DataFrame, sequences: DataFrame, width: int = WINDOW) -> DataFrame:
    """Windows of `width` bases over the spliced sequence (transcript_id, seq) for each of the `width` positions that follow
    a junction: transcript_id, contig, strand, stop (the position in the transcript), pos (on the genome), window (the bases
    before it). Exons shorter than a window are crossed as a chain. A position needs `width` bases before it."""
    order = Window.partitionBy("transcript_id").orderBy("number")
    before = F.sum(F.col("end") - F.col("start")).over(order.rowsBetween(Window.unboundedPreceding, -1)).cast("int")
    # A position that follows a junction by less than `width` follows that of its own exon so, too.
    own = exons.select("transcript_id", "contig", "strand", "start", "end", before.alias("o")).where("o > 0")
    tx = own.groupBy("transcript_id", "contig", "strand").agg(F.collect_list(F.struct("o", "start", "end")).alias("parts"))
    # What is needed of the sequence is cut out before there is a row for each exon and position.
    first = lambda x: F.greatest(x["o"] - width, F.lit(0))
    near = lambda x: F.struct(x["o"].alias("o"), x["start"].alias("start"), x["end"].alias("end"), first(x).alias("first"), F.substring("seq", first(x) + 1, x["o"] + width - first(x)).alias("near"))
    rows = tx.join(dealt(sequences.select("transcript_id", "seq")), "transcript_id")
    rows = rows.select("transcript_id", "contig", "strand", F.length("seq").alias("n"), F.transform("parts", near).alias("parts"))
    rows = rows.select("transcript_id", "contig", "strand", "n", F.inline("parts"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.lit(width), F.col("end") - F.col("start")) - 1))).withColumn("stop", F.col("o") + F.col("i"))
    at = F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("i")).otherwise(F.col("start") + F.col("i"))
    window = F.substring("near", F.col("stop") - width - F.col("first") + 1, F.lit(width))
    return rows.where(F.col("stop") >= width).where("stop < n").select("transcript_id", "contig", "strand", "stop", at.cast("int").alias("pos"), window.alias("window"))


def transcript_sequences(exons: DataFrame, tiled: DataFrame) -> DataFrame:
    """numbered exons -> transcript_id, seq: the exons' sequences 5' to 3'. tiled: the genome's tiles; exons meet them by
    contig and tile."""
    cut = genome.long_slices(exons.select("transcript_id", "contig", "strand", "number", "start", "end"), tiled)
    minus = F.col("strand") == "-"
    part = F.struct("number", F.when(minus, -F.col("tile")).otherwise(F.col("tile")).alias("nth"), F.when(minus, reverse_complement(F.col("cut"))).otherwise(F.col("cut")).alias("seq"))
    parts = cut.groupBy("transcript_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return parts.select("transcript_id", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))


def untranslated(exons: DataFrame, cds: DataFrame) -> DataFrame:
    """What of each exon lies before the first and after the last coding base: transcript_id, contig, strand, region
    (5UTR, 3UTR), start, end. Transcripts without coding sequence have none."""
    coding = cds.groupBy("transcript_id").agg(F.min("start").alias("c0"), F.max("end").alias("c1"))
    rows = exons.join(dealt(coding), "transcript_id")
    plus = F.col("strand") != "-"
    left = F.struct(F.when(plus, "5UTR").otherwise("3UTR").alias("region"), F.col("start").alias("s"), F.least("end", "c0").alias("e"))
    right = F.struct(F.when(plus, "3UTR").otherwise("5UTR").alias("region"), F.greatest("start", "c1").alias("s"), F.col("end").alias("e"))
    rows = rows.select("transcript_id", "contig", "strand", F.explode(F.array(left, right)).alias("u"))
    return rows.select("transcript_id", "contig", "strand", F.col("u.region").alias("region"), F.col("u.s").alias("start"), F.col("u.e").alias("end")).where("start < end")


def overlapping_transcripts(sites: DataFrame, transcripts: DataFrame, width: int = GENE_BIN) -> DataFrame:
    """sites (contig, strand, start, end, ...) with each transcript whose span, introns included, they overlap."""
    t = transcripts.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    return overlap_join(sites, t, width)


def regions_of(parts: Column, regions: Column) -> Column:
    """Of regions (an array of structs region, start, end) the names of those that any of the pieces overlaps, sorted."""
    meets = lambda r: F.exists(parts, lambda p: (p["start"] < r["end"]) & (r["start"] < p["end"]))
    return F.array_sort(F.array_distinct(F.transform(F.filter(regions, meets), lambda r: r["region"])))


def with_regions(transcripts: DataFrame, regions: DataFrame) -> DataFrame:
    """transcripts with regions: theirs, as an array of structs region, start, end."""
    own = regions.groupBy("transcript_id").agg(F.collect_list(F.struct("region", "start", "end")).alias("regions"))
    none = F.array().cast("array<struct<region:string,start:int,end:int>>")
    return transcripts.join(dealt(own), "transcript_id", "left").withColumn("regions", F.coalesce(F.col("regions").cast("array<struct<region:string,start:int,end:int>>"), none))


def annotated(places: DataFrame, transcripts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """places (keys, contig, strand, pieces) with each transcript of with_regions() whose span, introns included, overlaps any
    of the pieces: keys, gene_id, gene_name, transcript_id, regions (the names of those that the pieces meet)."""
    kept = [k for k in keys if k not in ("contig", "strand")]
    clash = {k: f"_k_{k}" for k in kept if k in ("start", "end")}
    own = places.select(*[F.col(k).alias(clash.get(k, k)) for k in kept], "contig", "strand", F.col("pieces").alias("_all"), F.inline("pieces"))
    found = overlapping_transcripts(own, transcripts).drop("start", "end", "r_start", "r_end").withColumnsRenamed({v: k for k, v in clash.items()})
    found = found.dropDuplicates([*keys, "transcript_id"])
    return found.select(*keys, "gene_id", "gene_name", "transcript_id", regions_of(F.col("_all"), F.col("regions")).alias("regions"))


def rollup(hit: DataFrame, keys: Sequence[str], refseq: bool = False) -> DataFrame:
    """hit (keys, gene_id, gene_name, transcript_id, regions: the names of those met) -> one row for each keys: gene_names,
    transcript_ids, coding_regions, each sorted and joined by ;. A gene none of whose regions is met counts as non_coding.
    refseq: only ids of the best prefix that is there count; N/A if there are none."""
    by_gene = hit.withColumn("gene", shown_name(F.col("gene_name"), F.col("gene_id"))).groupBy(*keys, "gene")
    genes = by_gene.agg(F.collect_set("transcript_id").alias("ids"), F.array_distinct(F.flatten(F.collect_list("regions"))).alias("own"))
    genes = genes.withColumn("own", F.when(F.size("own") == 0, F.array(F.lit("non_coding"))).otherwise(F.col("own")))
    ids = F.array_distinct(F.flatten(F.collect_list("ids")))
    out = genes.groupBy(*keys).agg(F.collect_set("gene").alias("genes"), ids.alias("ids"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
    out = out.withColumn("ids", by_priority(F.col("ids"))) if refseq else out
    joined = lambda c: F.coalesce(F.nullif(F.array_join(F.array_sort(c), ";"), F.lit("")), F.lit("N/A"))
    return out.select(*keys, joined("genes").alias("gene_names"), joined("ids").alias("transcript_ids"), joined("own").alias("coding_regions"))


def shown_name(name: Column, gene_id: Column) -> Column:
    """A gene's name; with its id unless the name says "gene"."""
    return F.when(F.contains(name, F.lit("gene")), name).otherwise(F.concat(name, F.lit("|"), gene_id))


def _starts_with(prefix: str) -> Callable[[Column], Column]:
    return lambda x: F.startswith(x, F.lit(prefix))


def by_priority(ids: Column) -> Column:
    """Of RefSeq ids those of the best prefix that is there."""
    kept = F.array().cast("array<string>")
    for p in reversed(REFSEQ_ORDER):
        of = F.filter(ids, _starts_with(p))
        kept = F.when(F.size(of) > 0, of).otherwise(kept)
    return kept


def inferred_type(types: Column) -> Column:
    """protein_coding before mRNA before all types there are."""
    return F.when(F.array_contains(types, "protein_coding"), "protein_coding").when(F.array_contains(types, "mRNA"), "mRNA").otherwise(F.array_join(F.array_sort(types), ","))


def contig_order(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """rows (contig, nth: their order in the annotation) -> contig, place: those that the genome has too, by first mention
    from 1. As many rows as there are contigs pass over one task."""
    first = rows.groupBy("contig").agg(F.min("nth").alias("first")).join(contigs.select("contig").distinct(), "contig", "left_semi")
    return first.select("contig", F.row_number().over(Window.orderBy("first", "contig")).alias("place"))
