"""Treatment against control: paired positions, the two-stage test, filters, and the rescue of split stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmap.constants import ALPHAS, COVERAGE_CHANGE, MIN_COVERAGE, RESCUE_DIFFERENCE, Z_VALUES
from stallmap.functions.genome import short_slices
from stallmap.functions.intervals import islands
from stallmap.functions.sequence import reverse_complement
from stallmap.functions.stats import first_alpha, margin, second_stage
from stallmap.operators.pileup import pileup_at_starts


def pairs(treatment: DataFrame, control: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two pile-ups joined by keys and pos: positions with a read start on either side and enough reads on both.
    The coverage filter stands on each side, below the join."""
    deep = F.col("cov") >= MIN_COVERAGE
    t = treatment.where(deep).withColumnsRenamed({"cov": "cov_t", "rss": "rss_t"})
    c = control.where(deep).withColumnsRenamed({"cov": "cov_c", "rss": "rss_c"})
    return t.join(c, [*keys, "pos"]).where("rss_t >= 1 or rss_c >= 1")


def pairs_of_blocks(blocks: DataFrame, keys: Sequence[str], cond: str = "cond", conditions: Sequence[str] = ("Li", "K", "KPDS"), weight: str | None = None) -> DataFrame:
    """What pairs() gives for the pile-ups of blocks, from the ends of blocks: coverage is worked out only where a read of
    any condition starts, as no other position can make a pair. conditions: the control, then the treatments. Those of
    a position come together by one grouping, where they are a few, within their bin: no join, and no other shuffle."""
    piled = pileup_at_starts(blocks, keys, cond, conditions, weight).where(F.col("cov") >= MIN_COVERAGE)
    side = lambda c: F.max(F.when(F.col(cond) == c, F.struct("cov", "rss"))).alias(f"_{c}")
    wide = piled.groupBy(*keys, "bin", "pos").agg(*[side(c) for c in conditions]).where(F.col(f"_{conditions[0]}").isNotNull())
    one = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.struct(F.lit(c).alias(cond), F.col(f"_{c}.cov").alias("cov_t"), F.col(f"_{c}.rss").alias("rss_t")))
    control = F.col(f"_{conditions[0]}")
    rows = wide.select(*keys, "pos", control["cov"].alias("cov_c"), control["rss"].alias("rss_c"), F.inline(F.array_compact(F.array(*[one(c) for c in conditions[1:]]))))
    return rows.where("rss_t >= 1 or rss_c >= 1").select(*keys, "pos", cond, "cov_t", "rss_t", "cov_c", "rss_c")


def signal_rows(paired: DataFrame, second: bool = True) -> DataFrame:
    """paired with first_alpha and second_alpha: tested with the side of the larger fraction as treatment; rows of
    equal fractions, and those that fail the first stage, go. decoy: the control's fraction is the larger."""
    t, c = F.col("rss_t") / F.col("cov_t"), F.col("rss_c") / F.col("cov_c")
    side = lambda name, other: F.when(t < c, F.col(other)).otherwise(F.col(name))
    sides = {"_rt": side("rss_t", "rss_c"), "_nt": side("cov_t", "cov_c"), "_rc": side("rss_c", "rss_t"), "_nc": side("cov_c", "cov_t")}
    # Each step goes through a generator: what it makes is computed once, and the filter below can't pull copies of
    # all of it under itself, which would outgrow what Spark compiles.
    out = paired.where(t != c).withColumn("decoy", t < c).select("*", _once(sides))
    columns = [F.col(x) for x in sides]
    names = [f"_m{k}" for k in range(len(ALPHAS))]
    out = out.select("*", _once({m: margin(*columns, z) for m, z in zip(names, Z_VALUES)}))
    margins = [F.col(m) for m in names]
    out = out.withColumn("first_alpha", first_alpha(F.col("_rt") / F.col("_nt"), margins)).where("first_alpha > 0")
    out = out.withColumn("second_alpha", second_stage(F.col("_nt"), margins)) if second else out
    return out.drop(*sides, *names)


def _once(columns: dict[str, Column]) -> Column:
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def passes(first_cutoff: Column | float, second_cutoff: Column | float) -> Column:
    """Both stages reach the cutoffs; the second one at the place of the first cutoff among the alphas."""
    first, second = (x if isinstance(x, Column) else F.lit(x) for x in (first_cutoff, second_cutoff))
    place = F.array_position(F.array(*[F.lit(a) for a in ALPHAS]), first).cast("int") - 1
    return (F.col("first_alpha") <= first) & F.coalesce(F.get("second_alpha", place) <= second, F.lit(False))


def reversed_roles(signal: DataFrame) -> DataFrame:
    """Rows where the control stops more, with treatment and control exchanged: the search for stops of the control."""
    swap = {"rss_t": "rss_c", "rss_c": "rss_t", "cov_t": "cov_c", "cov_c": "cov_t", "decoy": None}
    return signal.where("decoy").select(*[F.lit(False).alias(c) if c == "decoy" else F.col(swap.get(c, c)).alias(c) for c in signal.columns])


def next_base(signal: DataFrame, tiled: DataFrame) -> DataFrame:
    """signal with base3: the base at the 3' side of a stop, on its strand; '' beyond the contig."""
    at = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("pos") + 1)
    found = short_slices(signal, tiled, at, at + 1, "base3")
    return found.withColumn("base3", F.when(F.col("strand") == "+", F.col("base3")).otherwise(reverse_complement(F.col("base3"))))


def _steady(strand: Column, now: Column, before: Column) -> Column:
    """Whether coverage changes from one position to the next only by what starts there, to within a tenth."""
    out = F.lit(True)
    for side in ("t", "c"):
        left = lambda x: x[f"cov_{side}"] - x[f"rss_{side}"]  # noqa: B023, E731
        expected = F.when(strand == "+", left(now)).otherwise(left(before))
        seen = F.when(strand == "+", before[f"cov_{side}"]).otherwise(now[f"cov_{side}"])
        out &= F.coalesce(F.try_divide(F.abs(expected - seen), expected) <= COVERAGE_CHANGE, F.lit(False))
    return out


_ROW = "struct<pos:int,rss_t:bigint,cov_t:bigint,rss_c:bigint,cov_c:bigint,white:boolean,opens:boolean>"


def _groups(rows: Column, strand: Column) -> Column:
    """rows: neighbouring eligible rows in order of position -> the groups of two and more among them. A group begins at a row
    that may open one, and goes on with each whitelisted row that follows at the next base with steady coverage."""
    many, one = f"array<array<{_ROW}>>", f"array<{_ROW}>"
    kept = lambda done, group: F.when(F.size(group) >= 2, F.concat(done, F.array(group))).otherwise(done)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["group"], F.lit(-1))
        follows = F.coalesce(x["white"] & (x["pos"] == last["pos"] + 1) & _steady(strand, x, last), F.lit(False))
        fresh = F.when(x["opens"], F.array(x)).otherwise(F.array().cast(one))
        group = F.when(follows, F.concat(acc["group"], F.array(x))).otherwise(fresh)
        return F.struct(F.when(follows, acc["done"]).otherwise(kept(acc["done"], acc["group"])).cast(many).alias("done"), group.cast(one).alias("group"))

    none = F.struct(F.array().cast(many).alias("done"), F.array().cast(one).alias("group"))
    return F.aggregate(rows, none, step, lambda acc: kept(acc["done"], acc["group"]))


def rescue(signal: DataFrame, first_cutoff: Column | float, second_cutoff: Column | float, keys: Sequence[str], contig: str = "contig") -> DataFrame:
    """Called stops: rows that pass, and neighbouring rows that pass only when taken together.

    signal: keys (contig and strand among them), pos, counts, alphas, whitelisted and g_next (booleans), one row a
    position; the cutoffs may be columns of it. A row that passes and is whitelisted is called. Another row with a large
    difference of fractions is eligible: it extends a group of eligible rows if it follows at the next base with
    steady coverage and is whitelisted; else the group ends, and a new one begins if a G follows and it is whitelisted.
    A group of two or more is called if its summed starts, over the coverage of its 3'-most row, pass.

    In a walk along a sample a group waits until the next such row closes it, so the very last group of each sample and
    strand (by contig, then position) is not called if no such row comes after it. That is kept.

    Only rows of neighbouring positions meet in one place, as arrays; no contig is walked as a whole.
    """
    first, second = (x if isinstance(x, Column) else F.lit(x) for x in (first_cutoff, second_cutoff))
    rows = signal.where("rss_t / cov_t > rss_c / cov_c").withColumns({"_c1": first, "_c2": second})
    ok = passes(F.col("_c1"), F.col("_c2")) & F.col("whitelisted")
    large = F.col("rss_t") / F.col("cov_t") - F.col("rss_c") / F.col("cov_c") > RESCUE_DIFFERENCE
    rows = rows.withColumn("_ok", ok).where(F.col("_ok") | large)
    passing = rows.where("_ok").select(*keys, F.col("pos").cast("int").alias("start"), (F.col("pos") + 1).cast("int").alias("end"), "cov_t", "first_alpha", "second_alpha", F.lit(1).alias("merged"))

    row = F.struct(F.col("pos").cast("int").alias("pos"), "rss_t", "cov_t", "rss_c", "cov_c", F.col("whitelisted").alias("white"), (F.col("whitelisted") & F.col("g_next")).alias("opens")).cast(_ROW)
    of = [*keys, "_c1", "_c2"]
    eligible = rows.where("not _ok").select(*of, F.col("pos").cast("int").alias("start"), (F.col("pos") + 1).cast("int").alias("end"), F.array(row).alias("rows"))
    found = islands(eligible, of, 0, ["rows"]).where(F.size("rows") >= 2)
    groups = found.select(*of, F.explode(_groups(F.col("rows"), F.col("strand"))).alias("g"))
    total = lambda c: F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x[c])
    edge = F.when(F.col("strand") == "+", F.element_at("g", -1)).otherwise(F.element_at("g", 1))
    summed = groups.select(
        *of, F.element_at("g", 1)["pos"].alias("start"), (F.element_at("g", -1)["pos"] + 1).alias("end"), F.size("g").alias("merged"), edge["cov_t"].alias("cov_t"), edge["cov_c"].alias("cov_c"),
        F.least(total("rss_t"), edge["cov_t"]).alias("rss_t"), F.least(total("rss_c"), edge["cov_c"]).alias("rss_c"),
    )
    # One row a sample and strand: where its last row that passes or is eligible stands.
    file = [k for k in keys if k != contig]
    ends = rows.groupBy(*file).agg(F.max(F.struct(F.col(contig).alias("c"), (F.col("pos") + 1).cast("int").alias("e"))).alias("last"))
    closed = summed.join(F.broadcast(ends), file).where((F.col(contig) != F.col("last.c")) | (F.col("end") != F.col("last.e"))).drop("last")
    names = [f"_m{k}" for k in range(len(ALPHAS))]
    counts = [F.col(x) for x in ("rss_t", "cov_t", "rss_c", "cov_c")]
    tested = closed.select("*", _once({m: margin(*counts, z) for m, z in zip(names, Z_VALUES)}))
    margins = [F.col(m) for m in names]
    tested = tested.withColumn("first_alpha", first_alpha(F.col("rss_t") / F.col("cov_t"), margins)).withColumn("second_alpha", second_stage(F.col("cov_t"), margins))
    # At the place of the first cutoff; the first stage of the sum isn't asked again.
    place = F.array_position(F.array(*[F.lit(a) for a in ALPHAS]), F.col("_c1")).cast("int") - 1
    called = tested.where(F.coalesce(F.get("second_alpha", place) <= F.col("_c2"), F.lit(False)))
    return passing.unionByName(called.select(*keys, "start", "end", "cov_t", "first_alpha", "second_alpha", "merged"))


def rescue_groups(signal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbouring eligible rows in one pass of windows: keys, start, end, n, and the counts that a group is tested
    with. Rows: those with a large difference of fractions; a group goes on at the next base with steady coverage."""
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = signal.where(F.col("rss_t") / F.col("cov_t") - F.col("rss_c") / F.col("cov_c") > RESCUE_DIFFERENCE)
    joined = F.col("pos") == F.lag("pos").over(order) + 1
    now = F.struct("cov_t", "rss_t", "cov_c", "rss_c")
    joined &= _steady(F.col("strand"), now, F.lag(now).over(order))
    rows = rows.withColumn("new", (~F.coalesce(joined, F.lit(False))).cast("int"))
    rows = rows.withColumn("grp", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.when(F.col("strand") == "+", F.col("pos")).otherwise(-F.col("pos"))
    out = rows.groupBy(*keys, "grp").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("n"),
        F.max_by("cov_t", last).alias("cov_t"), F.max_by("cov_c", last).alias("cov_c"), F.sum("rss_t").alias("rss_t"), F.sum("rss_c").alias("rss_c"),
    )
    return out.drop("grp").withColumn("rss_t", F.least("rss_t", "cov_t")).withColumn("rss_c", F.least("rss_c", "cov_c"))
