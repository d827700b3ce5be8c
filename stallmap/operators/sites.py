"""Sites: called stops of replicates joined into islands, their support, coverage and picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmap.constants import K_REPLICATES, KPDS_REPLICATES, PICTURE_LABEL, SHOWN_FLANK
from stallmap.functions.intervals import islands, overlap_join, positions

SITE = ["contig", "strand", "start", "end"]


def replicate_id() -> Column:
    """r for a replicate of K, 10 r for one of KPDS."""
    return F.when(F.col("cond") == "KPDS", F.col("rep") * 10).otherwise(F.col("rep"))


def site_islands(hits: DataFrame) -> DataFrame:
    """hits (cond, rep, contig, strand, start, end) -> SITE and ids: hits at most one base apart, of whatever
    replicate, are one site; ids are the replicates that it has."""
    return islands(hits.withColumn("ids", F.array(replicate_id())), gap=1, sets=["ids"])


def is_supported(ids: Column, both: bool = True) -> Column:
    """With both conditions: a replicate of either and three in all. With one: two replicates."""
    if not both:
        return F.size(ids) >= 2
    of = lambda known: F.size(F.array_intersect(ids, F.array(*[F.lit(k) for k in known]))) >= 1
    return of(K_REPLICATES) & of(KPDS_REPLICATES) & (F.size(ids) >= 3)


def site_coverage(sites: DataFrame, hits: DataFrame, width: int = 64) -> DataFrame:
    """SITE with coverage: the mean over its positions and replicates where a hit has some, to the nearest whole
    number, halves to even."""
    h = hits.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    both = overlap_join(sites.select(*SITE), h, width).where("cov_t > 0")
    n = F.least("end", "r_end") - F.greatest("start", "r_start")
    return both.groupBy(*SITE).agg(F.bround(F.sum(F.col("cov_t") * n) / F.sum(n), 0).cast("long").alias("coverage"))


def marks(sites: DataFrame, hits: DataFrame, width: int = 64) -> DataFrame:
    """SITE with marks: for each sample that has called stops in it, a struct cond, rep, at (their positions). A site's positions
    are few; hits of one sample don't overlap."""
    h = hits.select("contig", "strand", "cond", "rep", "cov_t", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    both = overlap_join(sites.select(*SITE), h, width).where("cov_t > 0")
    at = F.sequence(F.greatest("start", "r_start"), F.least("end", "r_end") - 1)
    own = both.groupBy(*SITE, "cond", "rep").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(at)))).alias("at"))
    return own.groupBy(*SITE).agg(F.array_sort(F.collect_list(F.struct("cond", "rep", "at"))).alias("marks"))


def picture(parts: Column, after: Column, sequence: Column, flank: Column, strand: Column, lines: list[tuple[str, Column]]) -> Column:
    """A site's picture: a line of the bases of its motif and the first of those after it, then for each of lines (label,
    positions) * at the bases there and - elsewhere. Labels stand right-aligned in 16 columns."""
    shown = F.concat(positions(parts, strand), F.slice(positions(after, strand), 1, SHOWN_FLANK))
    draw = lambda at: F.array_join(F.transform(shown, lambda p: F.when(F.array_contains(at, p), "*").otherwise("-")), "")
    rows = [F.concat(F.lit(f"{label:>16}"), draw(at)) for label, at in lines]
    first = F.concat(F.lit(f"{'5' + chr(39) + '- ':>16}"), sequence, F.left(flank, F.lit(SHOWN_FLANK)), F.lit(" -3'"))
    return F.concat_ws("\n", first, *rows)


def picture_lines(conditions: list[str], replicates: list[int], breakdown: bool) -> list[tuple[str, Column]]:
    """Label and positions of each line: one a condition, or one a condition and replicate."""
    of = lambda test: F.flatten(F.transform(F.filter("marks", test), lambda m: m["at"]))

    def line(cond: str, rep: int | None) -> tuple[str, Column]:
        if rep is None:
            return f"{PICTURE_LABEL}{cond} ", of(lambda m: m["cond"] == cond)
        return f"{PICTURE_LABEL}{cond}-rep{rep}", of(lambda m: (m["cond"] == cond) & (m["rep"] == rep))

    return [line(c, r) for c in conditions for r in (replicates if breakdown else [None])]
