"""Half-open intervals on stranded contigs: overlap joins by bins, islands, unions, lists, pieces of spliced features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmap.functions.joins import dealt

STRANDED = ("contig", "strand")
TILE = 1 << 16
PIECES = "array<struct<start:int,end:int>>"


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))


def overlap_join(left: DataFrame, right: DataFrame, width: int, keys: Sequence[str] = STRANDED, l: tuple[str, str] = ("start", "end"), r: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """All pairs that overlap on the same keys. Both sides are dealt into bins of `width` bases and joined by
    key and bin, so that a contig isn't one partition and no pair is formed that shares no bin; a pair counts
    in the first bin that both are in, so none comes twice. width: about twice the usual length."""
    a = left.withColumn("_bin", _bins(F.col(l[0]), F.col(l[1]), width))
    b = right.withColumn("_bin", _bins(F.col(r[0]), F.col(r[1]), width))
    both = a.join(dealt(b), [*keys, "_bin"])
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width)
    return both.where((F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])) & (F.col("_bin") == first)).drop("_bin")


def points_within(points: DataFrame, intervals: DataFrame, width: int, keys: Sequence[str] = STRANDED, pos: str = "pos", r: tuple[str, str] = ("start", "end")) -> DataFrame:
    """The points that any interval covers: a left semi join by key and bin. A point is in one bin."""
    b = intervals.select(*keys, F.col(r[0]).alias("_s"), F.col(r[1]).alias("_e")).withColumn("_bin", _bins(F.col("_s"), F.col("_e"), width))
    a = points.withColumn("_bin", F.floor(F.col(pos) / width))
    on = [a[k] == b[k] for k in (*keys, "_bin")] + [(a[pos] >= b["_s"]) & (a[pos] < b["_e"])]
    return a.join(dealt(b), on, "left_semi").drop("_bin")


def islands(df: DataFrame, keys: Sequence[str] = STRANDED, gap: int = 0, sets: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Rows (keys, start, end) joined into islands where the next starts at most `gap` after the farthest end so
    far. sets: array columns of which an island gets the sorted union.

    Intervals are cut at the edges of tiles and joined within each tile, which spreads a contig over many tasks. Only
    islands that come within `gap` of an edge of their tile can go on beyond it: these alone, a few for each
    tile, pass over the whole contig."""
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]

    def pass_over(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("start", "end")
        before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = rows.withColumn("_new", F.coalesce((F.col("start") > before + gap).cast("int"), F.lit(0)))
        marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *union).drop("_island")

    kinds = dict(df.dtypes)
    low = F.col("_tile") * tile
    cut = df.select(*keys, "start", "end", *sets, _bins(F.col("start"), F.col("end"), tile).alias("_tile"))
    cut = cut.withColumn("start", F.greatest("start", low).cast(kinds["start"])).withColumn("end", F.least("end", low + tile).cast(kinds["end"]))
    tiled = pass_over(cut, [*keys, "_tile"]).withColumn("_edge", (F.col("start") <= low + gap) | (F.col("end") + gap >= low + tile))
    inner, edge = tiled.where("not _edge").drop("_tile", "_edge"), tiled.where("_edge").drop("_tile", "_edge")
    return inner.unionByName(pass_over(edge, keys).select(*inner.columns))


def union(df: DataFrame, keys: Sequence[str] = STRANDED) -> DataFrame:
    """Maximal covered stretches; touching intervals merge."""
    return islands(df, keys, 0)


def runs_of_positions(df: DataFrame, keys: Sequence[str] = STRANDED, pos: str = "pos") -> DataFrame:
    """Distinct positions as maximal runs."""
    return islands(df.select(*keys, F.col(pos).alias("start"), (F.col(pos) + 1).alias("end")).distinct(), keys, 0)


def runs_in(positions: Column) -> Column:
    """Positions of one row, an array in any order, as maximal runs: an array of (start, end), upwards."""
    def runs(p: Column) -> Column:
        first = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
        last = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))

    # Through an array, so that positions are sorted once and not for each of them.
    return F.transform(F.array(F.array_distinct(F.sort_array(positions))), runs)[0]


def in_order(positions: Column, strand: Column) -> Column:
    """Positions 5' to 3': upwards on +, downwards on -."""
    up = F.array_sort(positions)
    return F.when(strand == "-", F.reverse(up)).otherwise(up)


def pieces(exons: Column, start: Column, end: Column, strand: Column) -> Column:
    """Where [start, end) of a spliced feature lies on the genome, 5' to 3', as an array of (start, end). exons: its
    parts in order, an array of structs with start and end. Parts that touch on the genome give one piece."""
    plus = strand != "-"

    def put(acc: Column, x: Column) -> Column:
        n = x["end"] - x["start"]
        a, b = F.greatest(start - acc["o"], F.lit(0)), F.least(end - acc["o"], n)
        s = F.when(plus, x["start"] + a).otherwise(x["end"] - b).cast("int")
        e = F.when(plus, x["start"] + b).otherwise(x["end"] - a).cast("int")
        last = F.try_element_at(acc["p"], F.lit(-1))
        touches = F.coalesce(F.when(plus, last["end"] == s).otherwise(last["start"] == e), F.lit(False))
        merged = F.struct(F.least(last["start"], s).alias("start"), F.greatest(last["end"], e).alias("end"))
        alone = F.struct(s.alias("start"), e.alias("end"))
        grown = F.when(touches, F.concat(F.slice(acc["p"], 1, F.size(acc["p"]) - 1), F.array(merged))).otherwise(F.concat(acc["p"], F.array(alone)))
        return F.struct(F.when(a < b, grown).otherwise(acc["p"]).cast(PIECES).alias("p"), (acc["o"] + n).cast("int").alias("o"))

    first = F.struct(F.array().cast(PIECES).alias("p"), F.lit(0).alias("o"))
    return F.aggregate(exons, first, put, lambda acc: acc["p"])


def positions(parts: Column, strand: Column) -> Column:
    """The positions of pieces, 5' to 3'."""
    each = F.transform(parts, lambda p: F.when(strand == "-", F.sequence(p["end"] - 1, p["start"], F.lit(-1))).otherwise(F.sequence(p["start"], p["end"] - 1)))
    return F.flatten(each)


def as_text(contig: Column, start: Column, end: Column, strand: Column) -> Column:
    """contig:start-end:strand"""
    return F.concat(contig, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), strand)


def pieces_as_text(contig: Column, parts: Column, strand: Column) -> Column:
    """as_text() of each piece, joined by commas; '' without pieces."""
    return F.array_join(F.transform(parts, lambda p: as_text(contig, p["start"], p["end"], strand)), ",")


def pieces_from_text(text: Column) -> Column:
    """The pieces that pieces_as_text() wrote."""
    found = F.regexp_extract_all(text, F.lit(r":(\d+-\d+):[+\-.](?=,|$)"), F.lit(1))
    number = lambda x, i: F.split(x, "-")[i].cast("int")
    return F.transform(found, lambda x: F.struct(number(x, 0).alias("start"), number(x, 1).alias("end")))


def from_text(text: Column) -> Column:
    """The parts of contig:start-end:strand, as a struct; nulls if it isn't one."""
    pattern = r"^(.+):(\d+)-(\d+):([+\-.])(?::(\d+))?$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.struct(part(1).alias("contig"), part(2).cast("int").alias("start"), part(3).cast("int").alias("end"), part(4).alias("strand"), part(5).cast("int").alias("ord"))
