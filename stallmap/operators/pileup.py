"""Pile-ups: coverage and read starts per position, from aligned blocks (contig, strand, start, end, ord, weight)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 12


def read_start() -> Column:
    """The position at which a block's read starts: its first base on +, its last one on -."""
    return F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start"))


def pileup(blocks: DataFrame, keys: Sequence[str] = ("contig", "strand"), weight: str | None = None, width: int = BIN) -> DataFrame:
    """keys, pos, cov, rss: every covered position. Blocks are dealt out by keys and bin, each once, and only then exploded: a bin's
    coverage runs over their ends, and each stretch between two of them gives its bases. Bases aren't shuffled."""
    at = _summed(_dealt(blocks, keys, weight, width), keys)
    order = Window.partitionBy(*keys, "bin").orderBy("pos")
    runs = at.withColumn("cov", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("until", F.coalesce(F.lead("pos").over(order), ((F.col("bin") + 1) * width).cast("int"))).where("cov > 0")
    bases = runs.select(*keys, F.col("pos").alias("first"), "cov", "r", F.explode(F.sequence("pos", F.col("until") - 1)).alias("pos"))
    return bases.select(*keys, "pos", "cov", F.when(F.col("pos") == F.col("first"), F.col("r")).otherwise(0).cast("long").alias("rss"))


def _event(pos: Column, d: Column | int, r: Column | int, asked: bool) -> Column:
    """What happens at a position: coverage changes by d, r reads start there, or it is asked for."""
    as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.struct(pos.cast("int").alias("pos"), as_long(d).alias("d"), as_long(r).alias("r"), F.lit(int(asked)).alias("probe"))


def _cut(blocks: DataFrame, keys: Sequence[str], weight: str | None, width: int) -> DataFrame:
    """blocks -> keys, bin, start, end, at, w. Blocks are cut at the edges of bins, so that a bin needs nothing of the ones before
    it. at: where their read starts, if that is in this part."""
    w = F.col(weight) if weight else F.lit(1)
    parts = blocks.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width).cast("int"), F.floor((F.col("end") - 1) / width).cast("int"))))
    start, end = F.greatest("start", F.col("bin") * width), F.least("end", (F.col("bin") + 1) * width)
    at = F.when((F.col("ord") == 1) & (read_start() >= start) & (read_start() < end), read_start())
    return parts.select(*keys, "bin", start.cast("int").alias("start"), end.cast("int").alias("end"), at.cast("int").alias("at"), w.cast("long").alias("w"))


def _changes(width: int) -> Column:
    """The events of a part of a block: +w where it starts, -w where it ends unless its bin ends there, too, and its read's start."""
    opens = _event(F.col("start"), F.col("w"), F.when(F.col("at") == F.col("start"), F.col("w")).otherwise(0), False)
    closes = F.when(F.col("end") < (F.col("bin") + 1) * width, _event(F.col("end"), -F.col("w"), 0, False))
    begins = F.when(F.col("at") != F.col("start"), _event(F.col("at"), 0, F.col("w"), False))
    return F.array_compact(F.array(opens, closes, begins))


def _dealt(blocks: DataFrame, keys: Sequence[str], weight: str | None, width: int) -> DataFrame:
    """The events of blocks, by keys and bin: the parts of blocks are dealt out by these, and have events only where they arrive. What follows
    by keys and bin, and by more, needs no other shuffle."""
    return _cut(blocks, keys, weight, width).repartition(*keys, "bin").select(*keys, "bin", F.inline(_changes(width)))


def _summed(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.groupBy(*keys, "bin", "pos").agg(F.sum("d").alias("d"), F.sum("r").alias("r"), F.max("probe").alias("probe"))


def _running(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """events (keys, bin, pos, d, r, probe) -> keys, bin, pos, cov, rss at the positions that are asked for. Events of one position are
    added up; then a bin's positions stand in order."""
    within = Window.partitionBy(*keys, "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return _summed(events, keys).withColumn("cov", F.sum("d").over(within)).where("probe = 1").select(*keys, "bin", "pos", "cov", F.col("r").alias("rss"))


def coverage_at(blocks: DataFrame, probes: DataFrame, keys: Sequence[str] = ("contig", "strand"), weight: str | None = None, width: int = BIN) -> DataFrame:
    """probes (keys, pos) with cov and rss, without exploding bases: coverage is a running sum over the ends of blocks, within
    bins of the contig, so a long contig is spread over many tasks."""
    asked = probes.select(*keys, F.floor(F.col("pos") / width).cast("int").alias("bin"), F.inline(F.array(_event(F.col("pos"), 0, 0, True))))
    own = _cut(blocks, keys, weight, width).select(*keys, "bin", F.inline(_changes(width)))
    return _running(own.unionByName(asked), keys).drop("bin")


def pileup_at_starts(blocks: DataFrame, keys: Sequence[str], cond: str, conditions: Sequence[str], weight: str | None = None, width: int = BIN) -> DataFrame:
    """keys, cond, bin, pos, cov, rss of every condition, at each position where a read of any of them starts. conditions: all
    that there may be, a few. One scan of the blocks, one shuffle of them by keys and bin, and no join."""
    parts = _cut(blocks, [*keys, cond], weight, width).repartition(*keys, "bin")
    named = lambda c, e: F.struct(c.alias(cond), *[e[x].alias(x) for x in ("pos", "d", "r", "probe")])
    where = [named(F.lit(c), _event(F.col("at"), 0, 0, True)) for c in conditions]
    own = F.transform(_changes(width), lambda e: named(F.col(cond), e))
    both = F.when(F.col("at").isNotNull() & (F.col("w") > 0), F.concat(own, F.array(*where))).otherwise(own)
    return _running(parts.select(*keys, "bin", F.inline(both)), [*keys, cond])


def poisson_weight(key: Column, seed: int = 2018) -> Column:
    """A Poisson(1) number of copies of a read, from 32 bits of a hash of its name: the same on every run, for all its
    blocks. Numbers that come less often than once in 2 ** 32 reads (13 and more) can't come from so many bits."""
    u = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    edges = poisson_edges()
    out = F.lit(len(edges))
    for k, edge in reversed(list(enumerate(edges))):
        out = F.when(u < edge, k).otherwise(out)
    return out.cast("int")


def poisson_edges() -> list[float]:
    """The shares of Poisson(1) that are at most 0, 1, 2, ... as far as 32 bits tell them from all."""
    edges, term = [], 0.36787944117144233
    while not edges or 1 - edges[-1] > 2**-32:
        edges.append((edges[-1] if edges else 0.0) + term)
        term /= len(edges)
    return edges


#: Reads of a sample that are drawn from together, about.
DRAW_GROUP = 50_000


def bootstrap_draws(reads: DataFrame, n: int, sample: Sequence[str] = ("cond", "rep"), id_col: str = "read_id", seed: int = 2018, group: int = DRAW_GROUP) -> DataFrame:
    """reads (sample, id_col: each read once) -> sample, bootstrap (from 1 to n), id_col, copies: as many draws with replacement as a sample has
    reads, for each bootstrap; reads that aren't drawn have no row.

    Reads are dealt into groups by a hash of their id. How many draws a group gets is drawn first, group by group, as the binomial share of
    what is left; then the reads within it. Together that is one multinomial draw of just as many reads as there are. All depends
    on hashes and the seed alone, not on how rows are partitioned. A task holds one group, and one number for each group of a sample."""
    keys, kinds = list(sample), dict(reads.dtypes)
    fields = "".join(f"{c} {kinds[c]}, " for c in keys)
    sizes = reads.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") / group))
    named = F.xxhash64(F.lit(seed), *keys)
    dealt = reads.select(*keys, id_col).join(sizes.select(*keys, "groups"), keys).select(*keys, id_col, F.pmod(F.xxhash64(id_col, F.lit(seed)), F.col("groups")).alias("grp"), named.alias("stream"))
    counted = dealt.groupBy(*keys, "grp").agg(F.count("*").alias("k"), F.first("stream").alias("stream")).withColumn("bootstrap", F.explode(F.sequence(F.lit(1), F.lit(n))))
    numbers = lambda *parts: np.random.default_rng([int(x) & (1 << 64) - 1 for x in parts])

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("grp")
        r, left, draws, out = numbers(rows["stream"].iloc[0], rows["bootstrap"].iloc[0], 0), int(rows["k"].sum()), int(rows["k"].sum()), []
        for k in rows["k"].tolist():
            out.append(int(r.binomial(draws, k / left)))
            left, draws = left - k, draws - out[-1]
        return rows.assign(draws=out)[[*keys, "grp", "bootstrap", "draws"]]

    shares = counted.groupBy(*keys, "bootstrap").applyInPandas(share, f"{fields}grp long, bootstrap int, draws long")
    asked = shares.groupBy(*keys, "grp").agg(F.array_sort(F.collect_list(F.struct("bootstrap", "draws"))).alias("asked"))  # n at most

    def draw(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values(id_col), []
        for x in own["asked"].iloc[0]:
            r = numbers(rows["stream"].iloc[0], x["bootstrap"], key[-1] + 1)
            copies = np.bincount(r.integers(0, len(rows), x["draws"]), minlength=len(rows))
            at = np.flatnonzero(copies)
            out.append(rows.iloc[at][[*keys, id_col]].assign(bootstrap=x["bootstrap"], copies=copies[at]))
        return pd.concat(out)[[*keys, "bootstrap", id_col, "copies"]]

    return dealt.groupBy(*keys, "grp").cogroup(asked.groupBy(*keys, "grp")).applyInPandas(draw, f"{fields}bootstrap int, {id_col} {kinds[id_col]}, copies int")


def bootstrapped(blocks: DataFrame, n: int, sample: Sequence[str] = ("cond", "rep"), id_col: str = "read_id", seed: int = 2018) -> DataFrame:
    """blocks of bootstrap_draws(): with bootstrap and copies. Take bootstrap among the keys of pile-ups and pairs, and copies as the weight."""
    reads = blocks.select(*sample, id_col).distinct()
    return blocks.join(bootstrap_draws(reads, n, sample, id_col, seed), [*sample, id_col])
