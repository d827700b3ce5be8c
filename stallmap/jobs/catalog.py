"""The registered queries of the genomic operators, each with its SQL where SQL can express it.

All read the given tables whole, through the derived tables of lens.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallmap.constants import ALPHAS, WINDOW, Z_VALUES
from stallmap.functions import genome, intervals, sequence, stats
from stallmap.jobs import lens
from stallmap.operators import alignments, cutoff, pileup, signal
from stallmap.sources import tables
from stallmap.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SAMPLE = ["contig", "strand", "cond", "rep"]


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- pile-ups ----


def _pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.pileup(lens.blocks(spark, sf_dir), SAMPLE)


@query(f"WITH {lens.PILEUP} SELECT contig, strand, cond, rep, pos, cov, rss FROM pileup")
def pileup_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2."""
    return _pileup(spark, sf_dir)


@query(f"WITH {lens.PILEUP} SELECT contig, strand, cond, rep, pos, cov FROM pileup WHERE rss >= 1")
def pileup_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 from the ends of blocks, at the positions where reads start."""
    blocks = lens.blocks(spark, sf_dir)
    probes = blocks.select(*SAMPLE, pileup.read_start().alias("pos"))
    return pileup.coverage_at(blocks, probes, SAMPLE).drop("rss")


@query(f"WITH {lens.PILEUP} SELECT cond, rep, contig, strand, pos, cov, rss FROM pileup")
def parse_pileup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pile-up as lines of text and back."""
    lines = _pileup(spark, sf_dir).select("cond", "rep", tables.pileup_line().alias("value"))
    return tables.pileup_of(lines, "value", "cond", "rep")


@query(
    f"""WITH {lens.BLOCKS}, bases AS (
        SELECT contig, strand, cond, rep, weight, CAST(unnest(range(st, en)) AS INT) AS pos, CASE WHEN strand = '-' THEN en - 1 ELSE st END AS rs FROM blocks
    ) SELECT contig, strand, cond, rep, pos, CAST(sum(weight) AS BIGINT) AS cov, CAST(sum(CASE WHEN rs = pos THEN weight ELSE 0 END) AS BIGINT) AS rss
    FROM bases GROUP BY ALL"""
)
def weighted_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights come from a table of reads."""
    blocks = lens.blocks(spark, sf_dir)
    weights = blocks.select("read_id", F.col("weight").alias("w")).distinct()
    return pileup.pileup(blocks.drop("weight").join(weights, "read_id"), SAMPLE, "w")


@query(
    f"""WITH {lens.BLOCKS}, u AS (
        SELECT contig, strand, cond, rep, CAST(('0x' || md5(concat(CAST(read_id AS VARCHAR), '#2018'))[1:8]) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM blocks
    ) SELECT contig, strand, cond, rep, count(*) AS reads, CAST(sum(CASE {" ".join(f"WHEN u < {edge!r} THEN {k}" for k, edge in enumerate(pileup.poisson_edges()))} ELSE 13 END) AS BIGINT) AS copies
    FROM u GROUP BY ALL"""
)
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: how many copies of its reads each sample gets."""
    rows = lens.blocks(spark, sf_dir).withColumn("n", pileup.poisson_weight(F.col("read_id")))
    return rows.groupBy(*SAMPLE).agg(F.count("*").alias("reads"), F.sum("n").alias("copies"))


BOOTSTRAPS = 3


@query(f"WITH {lens.BLOCKS} SELECT cond, rep, CAST(b AS INT) AS bootstrap, count(*) AS copies FROM blocks, (SELECT unnest(range(1, {BOOTSTRAPS + 1})) AS b) GROUP BY ALL")
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: draws with replacement, as many as a sample has reads in each bootstrap."""
    drawn = pileup.bootstrap_draws(lens.blocks(spark, sf_dir).select("cond", "rep", "read_id"), BOOTSTRAPS)
    return drawn.groupBy("cond", "rep", "bootstrap").agg(F.sum("copies").alias("copies"))


@query()
def bootstrap_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 carried through the pile-up and the first stage: in how many of the bootstraps each position is a stop."""
    blocks = materialize(pileup.bootstrapped(lens.blocks(spark, sf_dir), BOOTSTRAPS), "bootstrapped")
    rows = signal.signal_rows(signal.pairs_of_blocks(blocks, ["contig", "strand", "rep", "bootstrap"], weight="copies"), False)
    return rows.where("not decoy").groupBy("contig", "strand", "rep", "cond", "pos").agg(F.count("*").alias("n"), F.min("first_alpha").alias("strictest"), F.max("first_alpha").alias("loosest"))


@query(
    f"""WITH {lens.PILEUP}, contigs AS (SELECT DISTINCT contig, cond FROM pileup)
    SELECT t.contig, t.cond FROM contigs t WHERE t.cond <> 'Li' AND t.contig IN (SELECT contig FROM contigs WHERE cond = 'Li')"""
)
def shared_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14, J12."""
    contigs = lens.blocks(spark, sf_dir).select("contig", "cond").distinct()
    return contigs.where("cond <> 'Li'").join(contigs.where("cond = 'Li'").select("contig"), "contig", "left_semi")


@query(
    f"""WITH {lens.BLOCKS}, t AS (SELECT concat(contig, ':', CAST(st AS VARCHAR), '-', CAST(en AS VARCHAR), ':', strand, ':1') AS line FROM blocks)
    SELECT regexp_extract(line, '^(.+):(\\d+)-(\\d+):([+.-]):(\\d+)$', 1) AS contig, CAST(regexp_extract(line, '^(.+):(\\d+)-(\\d+):([+.-]):(\\d+)$', 2) AS INT) AS start,
    CAST(regexp_extract(line, '^(.+):(\\d+)-(\\d+):([+.-]):(\\d+)$', 3) AS INT) AS "end", regexp_extract(line, '^(.+):(\\d+)-(\\d+):([+.-]):(\\d+)$', 4) AS strand,
    CAST(regexp_extract(line, '^(.+):(\\d+)-(\\d+):([+.-]):(\\d+)$', 5) AS INT) AS ord FROM t"""
)
def parse_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks to text and back."""
    line = F.concat(intervals.as_text(F.col("contig"), F.col("start"), F.col("end"), F.col("strand")), F.lit(":"), F.col("ord").cast("string"))
    return lens.blocks(spark, sf_dir).select(intervals.from_text(line).alias("p")).select("p.*")


# ---- alignments ----


@query(f"WITH {lens.ALIGNMENTS} SELECT qname, flag, contig, pos FROM alignments WHERE (flag & 3844) = 0 AND (mapq = 255 OR nh = 1)")
def flag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, single reads."""
    return lens.alignments(spark, sf_dir).where(alignments.keeps_flag("SE") & alignments.is_unique()).select("qname", "flag", "contig", "pos")


@query(f"WITH {lens.ALIGNMENTS} SELECT qname, flag, contig, pos FROM alignments WHERE (flag & 3980) = 0 AND (flag & 67) = 67 AND (mapq = 255 OR nh = 1)")
def flag_filter_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, read pairs."""
    return lens.alignments(spark, sf_dir).where(alignments.keeps_flag("PE") & alignments.is_unique()).select("qname", "flag", "contig", "pos")


@query(
    f"""WITH {lens.ALIGNMENTS} SELECT qname, flag, cigar, md, contig, pos FROM alignments
    WHERE CASE WHEN (flag & 16) <> 0 THEN regexp_extract(cigar, '([A-Z=])$', 1) ELSE regexp_extract(cigar, '^\\d+([A-Z=])', 1) END = 'M'
    AND CAST(CASE WHEN (flag & 16) <> 0 THEN regexp_extract(md, '(\\d+)$', 1) ELSE regexp_extract(md, '^(\\d+)', 1) END AS INT) > 0"""
)
def five_prime_clip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4."""
    return lens.alignments(spark, sf_dir).where(alignments.five_prime_is_sound()).select("qname", "flag", "cigar", "md", "contig", "pos")


@query(
    f"""WITH {lens.ALIGNMENTS}, parts AS (
        SELECT *, unnest(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) AS part, generate_subscripts(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'), 1) AS i FROM alignments
    ), sized AS (
        SELECT *, CAST(regexp_extract(part, '^(\\d+)', 1) AS INT) AS n, right(part, 1) AS op FROM parts
    ), placed AS (
        SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER (PARTITION BY qname, flag, contig, pos, cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sized
    ), aligned AS (
        SELECT *, row_number() OVER (PARTITION BY qname, flag, contig, pos, cigar ORDER BY i) AS k, count(*) OVER (PARTITION BY qname, flag, contig, pos, cigar) AS m FROM placed WHERE op IN ('M', '=', 'X')
    ) SELECT qname, flag, contig, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand, CAST(s AS INT) AS start, CAST(s + n AS INT) AS "end",
    CAST(CASE WHEN (flag & 16) <> 0 THEN m - k + 1 ELSE k END AS INT) AS ord FROM aligned"""
)
def block_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, D8."""
    return alignments.blocks(lens.alignments(spark, sf_dir)).select("qname", "flag", "contig", "strand", "start", "end", "ord")


@query(f"WITH {lens.ALIGNMENTS} SELECT contig, qname, n, dense_rank() OVER (PARTITION BY contig ORDER BY qname) AS read_id FROM (SELECT contig, qname, count(*) AS n FROM alignments GROUP BY ALL)")
def read_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of one read share an id."""
    order = Window.partitionBy("contig").orderBy("qname")
    return lens.alignments(spark, sf_dir).groupBy("contig", "qname").agg(F.count("*").alias("n")).withColumn("read_id", F.dense_rank().over(order).cast("long"))


# ---- the two-stage test ----


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.pairs_of_blocks(lens.blocks(spark, sf_dir), ["contig", "strand", "rep"])


def _bound(p: str, n: str, sign: str) -> str:
    return f"(({p} + z*z/(2*{n})) / (1 + z*z/{n}) {sign} z * sqrt({p}*(1-{p})/{n} + z*z/(4*{n}*{n})) / (1 + z*z/{n}))"


_ZS = ", ".join(f"{z!r}::DOUBLE" for z in Z_VALUES)
_AS = ", ".join(f"{a!r}::DOUBLE" for a in ALPHAS)
_SIGNAL = (
    lens.PAIRS
    + f""", sided AS (
    SELECT *, rss_t / cov_t < rss_c / cov_c AS decoy,
           CASE WHEN rss_t / cov_t < rss_c / cov_c THEN rss_c / cov_c ELSE rss_t / cov_t END AS pt, CAST(CASE WHEN rss_t / cov_t < rss_c / cov_c THEN cov_c ELSE cov_t END AS DOUBLE) AS nt,
           CASE WHEN rss_t / cov_t < rss_c / cov_c THEN rss_t / cov_t ELSE rss_c / cov_c END AS pc, CAST(CASE WHEN rss_t / cov_t < rss_c / cov_c THEN cov_t ELSE cov_c END AS DOUBLE) AS nc
    FROM pairs WHERE rss_t / cov_t <> rss_c / cov_c
), margined AS (
    SELECT *, list_transform([{_ZS}], lambda z: {_bound("pt", "nt", "-")} - {_bound("pc", "nc", "+")}) AS margins FROM sided
), staged AS (
    SELECT *, coalesce(list_position(list_transform(margins, lambda m: m < 0), true), {len(ALPHAS) + 1}) - 1 AS n_passed FROM margined
), signal AS (
    SELECT *, CASE WHEN pt < 0.05 OR n_passed = 0 THEN 0.0::DOUBLE ELSE [{_AS}][n_passed] END AS first_alpha FROM staged
), rows_ AS (SELECT * FROM signal WHERE first_alpha > 0), hits AS (
    SELECT contig, strand, cond, rep, pos, pos AS st, pos + 1 AS en, cov_t, first_alpha FROM rows_ WHERE NOT decoy
)"""
)


def _signal(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    return signal.signal_rows(_pairs(spark, sf_dir), second)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of the treatment at the loosest cutoff."""
    rows = _signal(spark, sf_dir).where("not decoy")
    return rows.select("contig", "strand", "cond", "rep", "pos", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "cov_t", "first_alpha")


@query(f"WITH {lens.PAIRS} SELECT contig, strand, rep, cond, pos, cov_t, rss_t, cov_c, rss_c, round(rss_t / cov_t, 9) AS fsr_t, round(rss_c / cov_c, 9) AS fsr_c FROM pairs")
def fsr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, F5, F6, P3."""
    rows = _pairs(spark, sf_dir)
    return rows.select("contig", "strand", "rep", "cond", "pos", "cov_t", "rss_t", "cov_c", "rss_c", F.round(stats.fraction(F.col("rss_t"), F.col("cov_t")), 9).alias("fsr_t"), F.round(stats.fraction(F.col("rss_c"), F.col("cov_c")), 9).alias("fsr_c"))


@query(f"WITH {lens.PAIRS}, x AS (SELECT *, rss_t / cov_t AS p, 1.9599639845400536::DOUBLE AS z FROM pairs) SELECT contig, strand, rep, cond, pos, round({_bound('p', 'cov_t', '-')}, 7) + 0.0::DOUBLE AS low, round({_bound('p', 'cov_t', '+')}, 7) + 0.0::DOUBLE AS high FROM x")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4."""
    low, high = stats.wilson(F.col("rss_t") / F.col("cov_t"), F.col("cov_t"), Z_VALUES[-1])
    return _pairs(spark, sf_dir).select("contig", "strand", "rep", "cond", "pos", (F.round(low, 7) + 0.0).alias("low"), (F.round(high, 7) + 0.0).alias("high"))


@query(f"WITH {_SIGNAL} SELECT contig, strand, rep, cond, pos, first_alpha FROM signal WHERE NOT decoy")
def first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, D11."""
    rows = _pairs(spark, sf_dir).where("rss_t / cov_t > rss_c / cov_c")
    return rows.select("contig", "strand", "rep", "cond", "pos", stats.first_stage(F.col("rss_t"), F.col("cov_t"), F.col("rss_c"), F.col("cov_c")).alias("first_alpha"))


@query(f"WITH {_SIGNAL} SELECT contig, strand, rep, cond, pos, cov_t, rss_t, cov_c, rss_c, decoy, first_alpha FROM rows_")
def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7, K5."""
    return _signal(spark, sf_dir).select("contig", "strand", "rep", "cond", "pos", "cov_t", "rss_t", "cov_c", "rss_c", "decoy", "first_alpha")


@query(f"WITH {_SIGNAL} SELECT cond, rep, strand, count(*) AS n, CAST(sum(CASE WHEN decoy THEN 1 ELSE 0 END) AS BIGINT) AS n_decoy FROM rows_ GROUP BY ALL")
def decoy_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows of either direction."""
    return _signal(spark, sf_dir).groupBy("cond", "rep", "strand").agg(F.count("*").alias("n"), F.sum(F.col("decoy").cast("long")).alias("n_decoy"))


# The quantile of stats.two_sided_quantile in SQL.


def _horner(coefficients: tuple[float, ...], r: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {r} + {c!r}::DOUBLE)"
    return out


def _z_sql(alpha: str) -> str:
    q, r = f"((1 - {alpha} / 2) - 0.5)", f"(0.180625 - ((1 - {alpha} / 2) - 0.5) * ((1 - {alpha} / 2) - 0.5))"
    r2 = f"(sqrt(-ln(1 - (1 - {alpha} / 2))) - 1.6)"
    return f"CASE WHEN {q} <= {stats.MIDDLE} THEN {_horner(stats.NEAR[0], r)} * {q} / {_horner(stats.NEAR[1], r)} ELSE {_horner(stats.FAR[0], r2)} / {_horner(stats.FAR[1], r2)} END"


_UPPER = "(0.025 + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(0.025*0.975/n + z*z/(4*n*n)) / (1 + z*z/n)"
_SECOND = (
    _SIGNAL
    + f""", asked AS (
    SELECT contig, strand, rep, cond, pos, unnest([1, 2, 3, 4, 5, 6, 7]) AS k, nt AS n, unnest(margins) AS rest FROM rows_
), edges AS (
    SELECT *, (SELECT {_UPPER.replace("z", repr(Z_VALUES[0]) + "::DOUBLE")}) AS u_loose, (SELECT {_UPPER.replace("z", repr(Z_VALUES[-1]) + "::DOUBLE")}) AS u_strict FROM asked
), walk AS (
    SELECT contig, strand, rep, cond, pos, k, n, rest, 0 AS step, 0.2::DOUBLE AS hi, 0.05::DOUBLE AS lo, CASE WHEN rest >= u_strict THEN 0.05::DOUBLE END AS ans FROM edges WHERE rest >= u_loose
    UNION ALL
    SELECT contig, strand, rep, cond, pos, k, n, rest, step + 1, CASE WHEN r > 0 THEN t ELSE hi END, CASE WHEN r > 0 THEN lo ELSE t END,
           CASE WHEN abs(r) < 0.001 OR step + 1 > 16 THEN t END
    FROM (SELECT *, rest - ({_UPPER}) AS r FROM (SELECT *, {_z_sql("t")} AS z FROM (SELECT *, (hi + lo) / 2 AS t FROM walk WHERE ans IS NULL)))
), answers AS (
    SELECT contig, strand, rep, cond, pos, k, ans FROM walk WHERE ans IS NOT NULL
), prefixed AS (
    SELECT *, row_number() OVER (PARTITION BY contig, strand, rep, cond, pos ORDER BY k) AS nth FROM answers
), second AS (
    SELECT contig, strand, rep, cond, pos, k, ans FROM prefixed WHERE nth = k
)"""
)
_SECOND = "RECURSIVE " + _SECOND


@query(f"WITH {_SECOND} SELECT contig, strand, rep, cond, pos, CAST(k - 1 AS INT) AS k, round(ans, 9) AS second_alpha FROM second")
def second_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each alpha of the prefix."""
    rows = _signal(spark, sf_dir, True).select("contig", "strand", "rep", "cond", "pos", F.posexplode("second_alpha").alias("k", "a"))
    return rows.select("contig", "strand", "rep", "cond", "pos", "k", F.round("a", 9).alias("second_alpha"))


@query(f"WITH {_SECOND} SELECT r.contig, r.strand, r.rep, r.cond, r.pos FROM rows_ r JOIN second s ON r.contig = s.contig AND r.strand = s.strand AND r.rep = s.rep AND r.cond = s.cond AND r.pos = s.pos WHERE NOT r.decoy AND r.first_alpha <= 0.1 AND s.k = 4 AND s.ans <= 0.1")
def alpha_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 at an alpha of 0.1 in both stages."""
    return _signal(spark, sf_dir, True).where(~F.col("decoy") & signal.passes(0.1, 0.1)).select("contig", "strand", "rep", "cond", "pos")


@query(
    f"""WITH {_SECOND}, listed AS (SELECT contig, strand, rep, cond, pos, count(*) AS n, min(ans) AS least, max(ans) AS most FROM second GROUP BY ALL)
    SELECT r.cond, r.rep, r.contig, r.strand, r.pos, r.cov_c AS cov_t, r.rss_c AS rss_t, r.cov_t AS cov_c, r.rss_t AS rss_c, r.first_alpha,
           CAST(coalesce(l.n, 0) AS INT) AS n_second, round(coalesce(l.least, 0), 9) AS least, round(coalesce(l.most, 0), 9) AS most
    FROM rows_ r LEFT JOIN listed l ON r.contig = l.contig AND r.strand = l.strand AND r.rep = l.rep AND r.cond = l.cond AND r.pos = l.pos"""
)
def parse_signal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal rows as ragged lines of text and back, with treatment and control exchanged."""
    lines = _signal(spark, sf_dir, True).select("cond", "rep", tables.signal_line().alias("value"))
    back = tables.signal_of(lines, "value", True, "cond", "rep")
    second = F.coalesce("second_alpha", F.array().cast("array<double>"))
    edge = lambda f: F.round(F.coalesce(f(second), F.lit(0.0)), 9)
    return back.select(*[c for c in back.columns if c != "second_alpha"], F.size(second).alias("n_second"), edge(F.array_min).alias("least"), edge(F.array_max).alias("most"))


@query(
    f"""WITH {lens.PAIRS}, el AS (
        SELECT * FROM pairs WHERE rss_t / cov_t - rss_c / cov_c > 0.1
    ), lagged AS (
        SELECT *, lag(pos) OVER w AS pb, lag(cov_t) OVER w AS ctb, lag(rss_t) OVER w AS rtb, lag(cov_c) OVER w AS ccb, lag(rss_c) OVER w AS rcb FROM el
        WINDOW w AS (PARTITION BY contig, strand, cond, rep ORDER BY pos)
    ), expect AS (
        SELECT *, CASE WHEN strand = '+' THEN cov_t - rss_t ELSE ctb - rtb END AS et, CASE WHEN strand = '+' THEN ctb ELSE cov_t END AS st,
                  CASE WHEN strand = '+' THEN cov_c - rss_c ELSE ccb - rcb END AS ec, CASE WHEN strand = '+' THEN ccb ELSE cov_c END AS sc FROM lagged
    ), marked AS (
        SELECT *, CASE WHEN coalesce(pos = pb + 1 AND et <> 0 AND ec <> 0 AND abs(et - st) / nullif(et, 0) <= 0.1 AND abs(ec - sc) / nullif(ec, 0) <= 0.1, false) THEN 0 ELSE 1 END AS fresh FROM expect
    ), grouped AS (
        SELECT *, sum(fresh) OVER (PARTITION BY contig, strand, cond, rep ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM marked
    ), summed AS (
        SELECT contig, strand, cond, rep, g, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n,
               CASE WHEN strand = '+' THEN arg_max(cov_t, pos) ELSE arg_min(cov_t, pos) END AS cov_t, CASE WHEN strand = '+' THEN arg_max(cov_c, pos) ELSE arg_min(cov_c, pos) END AS cov_c,
               CAST(sum(rss_t) AS BIGINT) AS st, CAST(sum(rss_c) AS BIGINT) AS sc FROM grouped GROUP BY contig, strand, cond, rep, g
    ) SELECT contig, strand, cond, rep, start, "end", n, cov_t, cov_c, least(st, cov_t) AS rss_t, least(sc, cov_c) AS rss_c FROM summed"""
)
def rescue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring stops taken together, by windows."""
    return signal.rescue_groups(_pairs(spark, sf_dir), SAMPLE).select(*SAMPLE, "start", "end", "n", "cov_t", "cov_c", "rss_t", "rss_c")


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genome's tiles, stored: they are met by several joins of a query."""
    return materialize(genome.tiles(lens.genome(spark, sf_dir)), "genome")


def white(tiles: DataFrame) -> DataFrame:
    """contig, pos: where windows of the whole contigs allow a stop on +."""
    whole = genome.lengths(tiles).select("contig", F.lit("+").alias("strand"), F.lit(0).alias("start"), F.col("length").alias("end"))
    return genome.windows(whole, tiles, 10).where(sequence.is_whitelisted(F.col("window"))).select("contig", "pos")


@query()
def rescue_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of neighbouring stops after the second stage. The whitelist is that of the contigs."""
    tiles = tiled(spark, sf_dir)
    rows = materialize(signal.next_base(_signal(spark, sf_dir, True).where("not decoy"), tiles).withColumn("g_next", F.col("base3") == "G"), "signal")
    runs = genome.whitelisted_runs(tiles, WINDOW)
    key = [*SAMPLE, "pos"]
    inside = intervals.points_within(rows, runs, 64, ["contig"]).select(*key, F.lit(True).alias("w"))
    return signal.rescue(rows.join(inside, key, "left").withColumn("whitelisted", F.coalesce("w", F.lit(False))), ALPHAS[0], ALPHAS[0], SAMPLE)


# ---- cutoffs ----

_LABELLED = (
    _SECOND
    + f", {lens.GENOME}"
    + """, labelled AS (
    SELECT r.cond, r.rep, CAST(s.k - 1 AS INT) AS k, round(s.ans, 9) AS alpha, NOT r.decoy AND CASE WHEN r.strand = '+' THEN substr(g.seq, r.pos + 1, 1) ELSE translate(substr(g.seq, r.pos + 2, 1), 'ACGT', 'TGCA') END = 'G' AS positive
    FROM rows_ r JOIN second s ON r.contig = s.contig AND r.strand = s.strand AND r.rep = s.rep AND r.cond = s.cond AND r.pos = s.pos JOIN genome g ON g.contig = r.contig
), points AS (
    SELECT cond, rep, k, alpha, CAST(sum(CASE WHEN positive THEN 1 ELSE 0 END) AS BIGINT) AS p, CAST(sum(CASE WHEN positive THEN 0 ELSE 1 END) AS BIGINT) AS n FROM labelled GROUP BY ALL
), curve AS (
    SELECT cond, rep, k, alpha, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, n_neg / (n_pos + n_neg) AS fdr FROM (
        SELECT *, sum(p) OVER w AS n_pos, sum(n) OVER w AS n_neg, sum(p) OVER (PARTITION BY cond, rep, k) AS positives FROM points WINDOW w AS (PARTITION BY cond, rep, k ORDER BY alpha)
    ) WHERE n > 0 AND positives > 0
), best AS (
    SELECT cond, rep, k, alpha, n_pos, n_neg, fdr FROM (
        SELECT *, row_number() OVER (PARTITION BY cond, rep, k ORDER BY CASE WHEN fdr <= 0.2 THEN 0 ELSE 1 END, CASE WHEN fdr <= 0.2 THEN -n_pos ELSE 0 END, CASE WHEN fdr <= 0.2 THEN 0 ELSE fdr END, alpha DESC) AS nth FROM curve
    ) WHERE nth = 1
)"""
)
FDR_SHOWN = 0.2


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives: stops of the treatment before a G."""
    rows = signal.next_base(_signal(spark, sf_dir, True), tiled(spark, sf_dir))
    real = ~F.col("decoy") & (F.col("base3") == "G")
    rows = rows.select("cond", "rep", real.alias("positive"), F.posexplode("second_alpha").alias("k", "a"))
    return cutoff.curve(rows.select("cond", "rep", "k", F.round("a", 9).alias("alpha"), "positive"), ("cond", "rep"))


@query(f"WITH {_LABELLED} SELECT cond, rep, k, alpha, n_pos, n_neg, round(fdr, 9) AS fdr FROM curve")
def fdr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, D14."""
    return _curve(spark, sf_dir).withColumn("fdr", F.round("fdr", 9))


@query(f"WITH {_LABELLED} SELECT cond, rep, k, alpha, n_pos, n_neg, round(fdr, 9) AS fdr FROM best")
def best_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return cutoff.best(_curve(spark, sf_dir), FDR_SHOWN, ("cond", "rep")).withColumn("fdr", F.round("fdr", 9))


@query(
    f"""WITH {_LABELLED} SELECT cond, rep, [{_AS}][k + 1] AS first_alpha, alpha AS second_alpha, n_pos, n_neg, round(fdr, 9) AS fdr FROM (
        SELECT *, row_number() OVER (PARTITION BY cond, rep ORDER BY CASE WHEN fdr <= 0.2 AND n_pos > 0 THEN 0 ELSE 1 END, CASE WHEN fdr <= 0.2 AND n_pos > 0 THEN -n_pos ELSE n_neg END, k) AS nth FROM best
    ) WHERE nth = 1"""
)
def global_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    bests = cutoff.best(_curve(spark, sf_dir), FDR_SHOWN, ("cond", "rep"))
    return cutoff.chosen(bests, FDR_SHOWN, ("cond", "rep")).withColumn("fdr", F.round("fdr", 9))


@query(
    f"""WITH {_LABELLED}, chosen AS (SELECT cond, rep, [{_AS}][k + 1] AS first_alpha, alpha AS second_alpha FROM (
        SELECT *, row_number() OVER (PARTITION BY cond, rep ORDER BY CASE WHEN fdr <= 0.2 AND n_pos > 0 THEN 0 ELSE 1 END, CASE WHEN fdr <= 0.2 AND n_pos > 0 THEN -n_pos ELSE n_neg END, k) AS nth FROM best
    ) WHERE nth = 1) SELECT cond, rep, first_alpha, second_alpha FROM chosen"""
)
def parse_cutoff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample's cutoffs as two lines of text and back."""
    chosen = cutoff.chosen(cutoff.best(_curve(spark, sf_dir), FDR_SHOWN, ("cond", "rep")), FDR_SHOWN, ("cond", "rep"))
    text = chosen.select("cond", "rep", F.concat(F.col("first_alpha").cast("string"), F.lit("\n"), F.col("second_alpha").cast("string"), F.lit("\n")).alias("value"))
    return tables.cutoff_of(text, "cond", "rep")


@query(f"WITH {lens.BLOCKS} SELECT DISTINCT read_id, weight FROM blocks")
def parse_weights_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of reads as lines of text and back."""
    lines = lens.blocks(spark, sf_dir).select("read_id", "weight").distinct().select(F.concat_ws("\t", "read_id", "weight").alias("value"))
    return tables.weights_of(lines)
