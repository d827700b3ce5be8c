"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document is wanted target / size-of-its-source times: the whole part
of that number is allocated for certain, as whole copies, and the rest is sampled. For the sample every
document gets the rank (u / (1 - u)) / (p / (1 - p)): random odds divided by inclusion odds. The documents
of smallest rank are taken until their words fill what the source still lacks, so that the sample has a
fixed size in words (to within half a document). Inclusion odds are those of the fraction wanted, times a
weight of the document: longer documents are likelier to get the extra copy.

u is a hash of the row, so reruns agree. The place where the sample ends is found by histograms over the
digits of the rank, SPLIT buckets a pass: no pass sorts a source or puts it into one task. Each pass keeps
only the bucket in which each source's sample ends; the last one orders at most LAST rows a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmap.llm.common import materialize, n_words, small, unit

SHARE = 1.5
MOST_COPIES = 2
WEIGHTS = (5.0, 2.0, 1.0)
SPLIT_BITS = 10
RANK_BITS = 40
ORDER_BITS = 60
LAST = 1000
MANY_SOURCES = 20_000


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST_COPIES, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> those and target.

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating, and split share * all
    sizes in proportion; a target stops at most * source_size and what is over is split among the others
    by weight, until none is above. This has a closed form: by growing source_size / weight, a source is
    full if an equal level over it and all later ones would overfill it. One row a source passes here.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    which = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (which + 1).cast("int"))
    capped = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    full = F.col("cap") <= level * F.col("weight")
    leveled = capped.withColumn("level", level).withColumn("full", full)
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.when(F.col("full") | final.isNull(), F.col("cap")).otherwise(F.least(final * F.col("weight"), F.col("cap")))
    return leveled.select("source", "source_size", target.alias("target"))


def _place(row: str, part: Column, seed: int) -> Column:
    """The rank of a row as an integer of ORDER_BITS bits that keeps its order: RANK_BITS bits of the rank, then
    bits of a hash of the row, which set the order of rows with equal ranks. Null: the row isn't sampled."""
    key, size, weight, uid = (F.col(f"{row}.{x}") for x in ("key", "size", "weight", "uid"))
    u = unit(F.lit(seed), key, size)
    rank = (u / (F.lit(1.0) - u)) / (weight * part / (F.lit(1.0) - part))
    top = F.least((rank / (F.lit(1.0) + rank) * F.lit(float(1 << RANK_BITS))).cast("long"), F.lit((1 << RANK_BITS) - 1))
    tie = F.shiftrightunsigned(F.xxhash64(key, uid), 64 - (ORDER_BITS - RANK_BITS))
    return F.when((part > 0) & (size > 0), F.shiftleft(top, ORDER_BITS - RANK_BITS) + tie)


def row(id_col: str, text_col: str, source_col: str) -> Column:
    """What the sampler looks at of a row of documents."""
    size = n_words(F.col(text_col))
    weight = F.lit(1.0) + F.log1p(size.cast("double"))
    uid = F.monotonically_increasing_id()
    return F.struct(F.col(id_col).alias("key"), F.col(source_col).alias("source"), size.alias("size"), weight.alias("weight"), uid.alias("uid"))


def plan(rows: DataFrame, share: float = SHARE, most: int = MOST_COPIES, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """rows (a struct column r of row(); materialised) -> for each source: its, source_size, target, whole, part,
    edge. edge: place and uid of the last row that its sample takes; null if it samples none."""
    size, source = F.col("r.size"), F.col("r.source")
    sums = materialize(rows.groupBy(source.alias("source")).agg(F.sum(size).alias("source_size")), "mix-sources")
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    goals = targets(sums, share, most, weights).withColumn("times", times).withColumn("whole", F.floor("times"))
    part = F.col("times") - F.col("whole")
    goals = materialize(goals.select(F.col("source").alias("its"), "source_size", "target", "whole", part.alias("part")), "mix-goals")

    ranked = rows.join(small(goals.select("its", "part"), MANY_SOURCES), source.eqNullSafe(F.col("its")))
    rest = ranked.select("its", size.alias("size"), F.col("r.uid").alias("uid"), _place("r", F.col("part"), seed).alias("place"))
    rest = materialize(rest.where("place is not null"), "mix-places")
    # base: the places from there, one bucket of them, are those among which a source's sample ends.
    ends = goals.where("part > 0").select(F.col("its").alias("of"), F.lit(0).cast("long").alias("base"), (F.col("part") * F.col("source_size")).alias("lacks"))
    of = F.col("its").eqNullSafe(F.col("of"))
    for bits in range(ORDER_BITS - SPLIT_BITS, -1, -SPLIT_BITS):
        low = F.shiftleft(F.shiftright("place", bits), bits).alias("low")
        counted = rest.groupBy("its", low).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        run = Window.partitionBy("its").orderBy("low")
        counted = counted.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
        ended = counted.join(small(ends.select("of", "base", "lacks"), MANY_SOURCES), of).where("before < lacks and upto >= lacks")
        ends = ended.select(F.col("its").alias("of"), F.col("low").alias("base"), (F.col("lacks") - F.col("before")).alias("lacks"), "n")
        ends = materialize(ends, "mix-ends")
        inside = (F.col("place") >= F.col("base")) & (F.col("place") < F.col("base") + F.lit(1 << bits))
        rest = rest.join(small(ends.select("of", "base"), MANY_SOURCES), of & inside).drop("of", "base")
        if ends.where(F.col("n") > LAST).isEmpty():
            break

    # The last few rows of each source, in order: the sample ends as near as can be to what is lacking.
    run = Window.partitionBy("its").orderBy("place", "uid")
    lasts = rest.withColumn("upto", F.sum("size").over(run)).join(small(ends, MANY_SOURCES), of)
    before = F.struct((F.col("base") - 1).alias("place"), F.lit(0).cast("long").alias("uid"))
    mine = F.when(F.col("upto") - F.col("size") / 2 <= F.col("lacks"), F.struct("place", "uid")).otherwise(before)
    edges = lasts.groupBy(F.col("its").alias("of")).agg(F.max(mine).alias("edge"))
    return materialize(goals.join(edges, of, "left").drop("of"), "mix-plan")


def allot(rows: DataFrame, r: str, goals: DataFrame, seed: int = 7) -> DataFrame:
    """rows with its, source_size, target and copies (long): the whole copies of its source, and one more if its
    place comes before the edge. A broadcast of one row a source; documents aren't shuffled."""
    out = rows.join(small(goals, MANY_SOURCES), F.col(f"{r}.source").eqNullSafe(F.col("its")), "left")
    place = _place(r, F.col("part"), seed)
    edge = F.col("edge")
    taken = (place < edge["place"]) | ((place == edge["place"]) & (F.col(f"{r}.uid") <= edge["uid"]))
    return out.withColumn("copies", F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")).drop("whole", "part", "edge")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **how) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, copies.

    size: words of the text, 0 for null. Null sources are one source, the last one. A source without words
    has target 0. Repeated rows count each by itself; which of them gets a copy doesn't show in the result. Of equal ranks
    the smaller row number comes first. Very long texts are counted whole, and never move.
    An empty table gives no rows. Other columns of docs are not looked at.
    """
    rows = materialize(docs.select(row(id_col, text_col, source_col).alias("r")), "mix-rows")
    got = allot(rows, "r", plan(rows, seed=seed, **how), seed)
    return got.select(
        F.col("r.key").alias("doc_id"), F.col("r.source").alias("source"), F.col("r.size").alias("size"),
        "source_size", "target", (F.col("copies") * F.col("r.size")).alias("taken"), "copies",
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **how) -> DataFrame:
    """The mix itself: each row of docs, with just its columns, as often as mix() allots it. Null and empty
    cases are as there; very long texts move with their row. Row numbers decide only between rows alike in id and size; docs should come from
    stored files, so that these numbers stay the same from one read to the next."""
    rows = materialize(docs.select(row(id_col, text_col, source_col).alias("r")), "mix-rows")
    packed = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("doc"), row(id_col, text_col, source_col).alias("r"))
    got = allot(packed, "r", plan(rows, seed=seed, **how), seed).where("copies > 0")
    return got.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth")).select("doc.*")
