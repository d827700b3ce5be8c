"""Hand-made cases, properties and plans of the genomic operators."""

import random
import re
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallmap.constants import ALPHAS, MOTIF_KINDS, Z_VALUES, motif_pattern
from stallmap.functions import genome, intervals, sequence, stats
from stallmap.jobs import catalog
from stallmap.operators import alignments, annotation, cutoff, motif, pileup, report, signal, sites


def one(df):
    return df.collect()[0][0]


def test_quantiles():
    assert Z_VALUES == pytest.approx([NormalDist().inv_cdf(1 - a / 2) for a in ALPHAS], abs=1e-12)
    many = np.linspace(0.0001, 0.999, 2000)
    assert stats.two_sided_quantile(many) == pytest.approx([NormalDist().inv_cdf(1 - a / 2) for a in many], abs=1e-12)


def test_poisson_weights(spark):
    n = [x[0] for x in spark.range(20_000).select(pileup.poisson_weight(F.col("id"))).collect()]
    assert abs(np.mean(n) - 1) < 0.03 and abs(np.var(n) - 1) < 0.06 and len(pileup.poisson_edges()) == 13


@pytest.fixture(scope="module")
def blocks(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        s = r.choice([r.randint(0, 300), 4090, 9000])
        rows.append((r.choice("ab"), r.choice("+-"), s, s + r.randint(1, 80), r.randint(1, 2), r.randint(1, 3)))
    return spark.createDataFrame(rows, "contig string, strand string, start int, end int, ord int, weight int")


def test_pileup(blocks):
    got = {(x.contig, x.strand, x.pos): (x.cov, x.rss) for x in pileup.pileup(blocks, weight="weight").collect()}
    cov, rss = Counter(), Counter()
    for b in blocks.collect():
        for p in range(b.start, b.end):
            cov[b.contig, b.strand, p] += b.weight
        if b.ord == 1:
            rss[b.contig, b.strand, b.start if b.strand == "+" else b.end - 1] += b.weight
    assert got == {k: (v, rss[k]) for k, v in cov.items()}
    assert all(r <= c for c, r in got.values())


def test_coverage_by_ends_equals_exploded(blocks):
    exploded = pileup.pileup(blocks, weight="weight")
    probes = exploded.select("contig", "strand", "pos").unionByName(exploded.select("contig", "strand", (F.col("pos") + 5000).alias("pos")))
    got = {(x.contig, x.strand, x.pos): x.cov for x in pileup.coverage_at(blocks, probes, weight="weight", width=64).collect()}
    expected = {(x.contig, x.strand, x.pos): x.cov for x in exploded.collect()}
    assert {k: v for k, v in got.items() if v} == expected and min(got.values()) == 0


@pytest.mark.parametrize("width", [7, 4096])
def test_pairs_of_blocks_are_those_of_pileups(spark, width, monkeypatch):
    r = random.Random(width)
    rows = [(r.choice("ab"), r.choice("+-"), r.choice(["Li", "K", "KPDS"]), s := r.randint(0, 60), s + r.randint(1, 40), r.randint(1, 2)) for _ in range(900)]
    df = spark.createDataFrame(rows, "contig string, strand string, cond string, start int, end int, ord int")
    piled = pileup.pileup(df, ["contig", "strand", "cond"])
    plain = signal.pairs(piled.where("cond <> 'Li'"), piled.where("cond = 'Li'").drop("cond"), ["contig", "strand"])
    wide = pileup.pileup_at_starts
    monkeypatch.setattr(signal, "pileup_at_starts", lambda *a: wide(*a, width=width))
    got = signal.pairs_of_blocks(df, ["contig", "strand"])
    assert Counter(map(tuple, got.select(plain.columns).collect())) == Counter(map(tuple, plain.collect())) and got.count() > 100


def test_overlap_join_equals_naive(spark):
    r = random.Random(3)
    make = lambda n, most: [(r.choice("ab"), r.choice("+-"), s := r.randint(0, 500), s + r.randint(1, most)) for _ in range(n)]
    a, b = spark.createDataFrame(make(200, 40), "contig string, strand string, start int, end int"), spark.createDataFrame(make(200, 200), "contig string, strand string, r_start int, r_end int")
    got = Counter(tuple(x) for x in intervals.overlap_join(a, b, 16).select("contig", "strand", "start", "end", "r_start", "r_end").collect())
    expected = Counter((x.contig, x.strand, x.start, x.end, y.r_start, y.r_end) for x in a.collect() for y in b.collect() if (x.contig, x.strand) == (y.contig, y.strand) and x.start < y.r_end and y.r_start < x.end)
    assert got == expected
    points = a.select("contig", "strand", F.col("start").alias("pos"))
    within = intervals.points_within(points, b.withColumnsRenamed({"r_start": "start", "r_end": "end"}), 16).count()
    assert within == sum(any((p.contig, p.strand) == (y.contig, y.strand) and y.r_start <= p.pos < y.r_end for y in b.collect()) for p in points.collect())


@pytest.mark.parametrize("gap", [0, 1, 5])
def test_islands_do_not_depend_on_tiles(spark, gap):
    r = random.Random(gap)
    rows = [("c", "+", s := r.randint(0, 2000), s + r.randint(1, 30), [r.randint(1, 4)]) for _ in range(150)]
    df = spark.createDataFrame(rows, "contig string, strand string, start int, end int, ids array<int>")
    out, expected = sorted(rows, key=lambda x: (x[2], x[3])), []
    for _, _, s, e, ids in out:
        if expected and s <= expected[-1][1] + gap:
            expected[-1][1] = max(expected[-1][1], e)
            expected[-1][2] |= set(ids)
        else:
            expected.append([s, e, set(ids)])
    for tile in (64, 1 << 16):
        got = sorted((x.start, x.end, tuple(x.ids)) for x in intervals.islands(df, gap=gap, sets=["ids"], tile=tile).collect())
        assert got == [(s, e, tuple(sorted(i))) for s, e, i in expected]
    once = intervals.islands(df, gap=gap)
    assert Counter(map(tuple, intervals.islands(once, gap=gap).collect())) == Counter(map(tuple, once.collect()))


def test_text_form(spark):
    row = spark.sql("SELECT 'chr:1' contig, 5 start, 9 end, '-' strand").select(intervals.from_text(intervals.as_text(F.col("contig"), F.col("start"), F.col("end"), F.col("strand"))).alias("p")).select("p.*")
    assert tuple(row.collect()[0])[:4] == ("chr:1", 5, 9, "-")


def test_bisection_is_literal():
    """The same answer as the plain loop, its last step included."""

    def upper(a, n):
        z = NormalDist().inv_cdf(1 - a / 2)
        d = 1 + z * z / n
        return (0.025 + z * z / (2 * n)) / d + z * np.sqrt(0.025 * 0.975 / n + z * z / (4 * n * n)) / d

    def plain(rest, n):
        if rest - upper(0.2, n) < 0:
            return None
        if rest - upper(0.05, n) >= 0:
            return 0.05
        hi, lo, count = 0.2, 0.05, 0
        while True:
            t = (hi + lo) / 2
            x, count = rest - upper(t, n), count + 1
            if abs(x) < 0.001 or count > 16:
                return t
            hi, lo = (t, lo) if x > 0 else (hi, t)

    r = random.Random(0)
    cases = [(r.uniform(0, 0.3), r.randint(6, 100_000)) for _ in range(500)] + [(upper(0.1, 7) + d, 7) for d in (-0.002, 0, 0.002)]
    got = stats.bisect_alpha(np.array([c[0] for c in cases]), np.array([float(c[1]) for c in cases]))
    assert [None if np.isnan(g) else g for g in got] == pytest.approx([plain(*c) for c in cases])


def test_first_stage(spark):
    rows = spark.createDataFrame([(30, 40, 1, 40), (1, 40, 0, 40), (20, 40, 19, 40), (6, 20, 1, 20)], "a int, b int, c int, d int")
    got = [x[0] for x in rows.select(stats.first_stage(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[0] == 0.05 and got[1] == 0.0 and got[2] == 0.0 and got[3] in (*ALPHAS, 0.0)


def signal_frame(spark, rows, strand="+"):
    full = [("c", strand, "K", 1, *x) for x in rows]
    return spark.createDataFrame(full, "contig string, strand string, cond string, rep int, pos int, rss_t long, cov_t long, rss_c long, cov_c long, first_alpha double, second_alpha array<double>, whitelisted boolean, g_next boolean")


def test_rescue_walk(spark):
    weak, strong = (0.2, None), (0.05, [0.1] * 7)
    rows = [
        (10, 30, 100, 1, 100, *weak, True, True), (11, 30, 130, 1, 101, *weak, True, False),  # together they pass
        (12, 60, 190, 1, 102, *strong, True, True),  # closes the group
        (20, 30, 100, 1, 100, *weak, True, True), (22, 30, 130, 1, 101, *weak, True, True),  # not neighbours
        (30, 30, 100, 1, 100, *weak, True, False), (31, 30, 130, 1, 100, *weak, True, False),  # no G: never opened
        (40, 30, 100, 1, 100, *weak, True, True), (41, 30, 300, 1, 100, *weak, True, False),  # coverage jumps
        (50, 30, 100, 1, 100, *weak, True, True), (51, 30, 130, 1, 101, *weak, True, False),  # open at the end: lost
    ]
    got = sorted((x.start, x.end, x.merged) for x in signal.rescue(signal_frame(spark, rows), 0.2, 0.2, ["contig", "strand", "cond", "rep"]).collect())
    assert got == [(10, 12, 2), (12, 13, 1)]
    minus = [(10, 30, 130, 1, 101, *weak, True, True), (11, 30, 100, 1, 100, *weak, True, False), (12, 60, 100, 1, 100, *strong, True, True)]
    called = signal.rescue(signal_frame(spark, minus, "-"), 0.2, 0.2, ["contig", "strand", "cond", "rep"]).collect()
    assert {(x.start, x.end, x.cov_t) for x in called} == {(10, 12, 130), (12, 13, 100)}


def walked(rows, strand, k, c2):
    """Groups of one sample and strand by a plain walk, of those that a later row closes: (start, end, number of rows)."""
    steady = lambda e, s: e != 0 and abs(e - s) / e <= 0.1
    out, group = [], []
    for r in sorted(rows):
        _, pos, rt, ct, rc, cc, a1, a2, white, opens = r
        if rt / ct <= rc / cc:
            continue
        if a1 <= ALPHAS[k] and a2 and len(a2) > k and a2[k] <= c2 and white:
            out += [group] if len(group) > 1 else []
            out.append([r])
            group = []
        elif rt / ct - rc / cc > 0.1:
            b = group[-1] if group else None
            if b and white and b[0] == r[0] and pos == b[1] + 1 and (
                steady(ct - rt, b[3]) and steady(cc - rc, b[5]) if strand == "+" else steady(b[3] - b[2], ct) and steady(b[5] - b[4], cc)
            ):
                group.append(r)
                continue
            out += [group] if len(group) > 1 else []
            group = [r] if white and opens else []
    return [(g[0][0], g[0][1], g[-1][1] + 1, len(g)) for g in out]


@pytest.mark.parametrize("strand", ["+", "-"])
def test_rescue_equals_a_walk(spark, strand):
    r = random.Random(strand)
    rows = []
    for contig in "abc":
        pos = 0
        for _ in range(400):
            pos += r.choice([1, 1, 1, 2, 9])
            strong = r.random() < 0.15
            rows.append((contig, pos, r.choice([20, 21, 22, 60]), r.choice([100, 101, 108, 125]), r.choice([0, 1, 2, 40]), r.choice([100, 102, 150]), 0.05 if strong else 0.2, [0.1] * 7 if strong else None, r.random() < 0.8, r.random() < 0.6))
    cols = "contig string, pos int, rss_t long, cov_t long, rss_c long, cov_c long, first_alpha double, second_alpha array<double>, whitelisted boolean, g_next boolean"
    df = spark.createDataFrame(rows, cols).withColumn("strand", F.lit(strand)).withColumn("rep", F.lit(1))
    # With a loose second cutoff all groups whose sum passes at all are called.
    got = {(x.contig, x.start, x.end, x.merged) for x in signal.rescue(df, 0.2, 0.2, ["contig", "strand", "rep"]).collect()}
    expected = walked(rows, strand, 0, 0.2)
    singles = {x for x in expected if x[3] == 1}
    of = {(c, p): (a, b, d, e) for c, p, a, b, d, e, *_ in rows}

    def sums(x):
        own = [of[x[0], p] for p in range(x[1], x[2])]
        edge = own[-1] if strand == "+" else own[0]
        return min(sum(o[0] for o in own), edge[1]), edge[1], min(sum(o[2] for o in own), edge[3]), edge[3]

    z = NormalDist().inv_cdf(0.9)
    bound = lambda p, n, s: (p + z * z / (2 * n) + s * z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    passing = {x for x in expected if x[3] > 1 and bound(sums(x)[0] / sums(x)[1], sums(x)[1], -1) - bound(sums(x)[2] / sums(x)[3], sums(x)[3], 1) >= bound(0.025, sums(x)[1], 1)}
    assert got == singles | passing and len(passing) > 4 and len(passing) <= len(expected) - len(singles)


def test_cutoffs(spark):
    rows = [(0, a, True) for a in (0.05, 0.06, 0.1, 0.1, 0.15, 0.18)] + [(0, a, False) for a in (0.1, 0.17, 0.2)] + [(1, 0.05, True), (1, 0.05, False)]
    labelled = spark.createDataFrame(rows, "k int, alpha double, positive boolean")
    points = {(x.k, x.alpha): (x.n_pos, x.n_neg) for x in cutoff.curve(labelled).collect()}
    assert points == {(0, 0.1): (4, 1), (0, 0.17): (5, 2), (0, 0.2): (6, 3), (1, 0.05): (1, 1)}
    best = {x.k: x.alpha for x in cutoff.best(cutoff.curve(labelled), 0.3).collect()}
    assert best == {0: 0.17, 1: 0.05}
    chosen = cutoff.chosen(cutoff.best(cutoff.curve(labelled), 0.3), 0.3).collect()[0]
    assert (chosen.first_alpha, chosen.second_alpha) == (0.2, 0.17)
    worst = cutoff.chosen(cutoff.best(cutoff.curve(labelled), 0.01), 0.01).collect()[0]
    assert worst.n_neg == 1
    assert cutoff.chosen(cutoff.best(cutoff.curve(labelled.limit(0)))).count() == 0


def test_sequence_functions(spark):
    seq = "GGGATNNacgGGTTGGGGGGAGG"
    df = spark.createDataFrame([(seq,)], "s string")
    f = lambda c: one(df.select(c))
    assert f(sequence.reverse_complement(sequence.reverse_complement(F.col("s")))) == seq
    assert f(sequence.reverse_complement(F.lit("ACGTN"))) == "NACGT"
    cases = {"GGA": True, "GG": False, "GGAAA": False, "GAGAG": True, "AAGAA": False, "GGAAAG": True}
    assert {w: f(sequence.is_whitelisted(F.lit(w))) for w in cases} == cases
    assert f(sequence.g_runs(F.lit("GGAGGAGG"))) == 3 and f(sequence.g_runs(F.lit("GGGGGGAGGAGGTT"))) == 4
    assert f(sequence.g_runs(F.lit("GGAGG"))) is None and f(sequence.g_runs(F.lit("GGAGGAGGTTT"))) is None
    w = "A" * 30 + "G" * 30
    assert f(sequence.g_percent(F.lit(w))) == pytest.approx(max(100 * w[i:].count("G") / (50 - i) for i in range(40)))
    assert f(sequence.novel_verdict(F.lit("A" * 60))) == "Unknown"


@pytest.mark.parametrize("width, block", [(16, 3), (4096, 128)])
def test_windows_over_tiles(spark, monkeypatch, width, block):
    monkeypatch.setattr(genome, "WIDTH", width)
    monkeypatch.setattr(genome, "REACH", 12)
    monkeypatch.setattr(genome, "BLOCK", block)
    r = random.Random(width)
    seqs = {c: "".join(r.choice("ACGT") for _ in range(n)) for c, n in (("a", 72), ("b", 10), ("c", 11), ("d", 0), ("e", 33))}
    tiled = genome.tiles(spark.createDataFrame(list(seqs.items()), "contig string, seq string"))
    assert {(x.contig, x.length) for x in genome.lengths(tiled).collect()} == {(c, len(s)) for c, s in seqs.items() if s}
    where = [("a", "+", 0, 72), ("a", "-", 5, 60), ("a", "+", 40, 49), ("b", "+", 0, 10), ("c", "-", 0, 11), ("c", "+", 0, 11), ("e", "+", 20, 33)]
    stretches = spark.createDataFrame(where, "contig string, strand string, start int, end int")
    comp = str.maketrans("ACGT", "TGCA")
    expected = Counter()
    for c, strand, s, e in where:
        e = min(e, len(seqs[c]))
        for p in range(s, e):
            if strand == "+" and p - 10 >= s:
                expected[c, strand, p, seqs[c][p - 10 : p]] += 1
            if strand == "-" and p + 10 < e:
                expected[c, strand, p, seqs[c][p + 1 : p + 11].translate(comp)[::-1]] += 1
    assert Counter(map(tuple, genome.windows(stretches, tiled, 10).collect())) == expected
    spots = spark.createDataFrame([("a", p, p + n) for p in range(-4, 74) for n in (1, 12)], "contig string, s int, e int")
    for x in genome.short_slices(spots, tiled, F.col("s"), F.col("e"), "cut").collect():
        assert x.cut == seqs["a"][max(x.s, 0) : max(x.e, 0)]


def test_upstream(spark):
    r = random.Random(1)
    seq = "".join(r.choice("ACGT") for _ in range(200))
    tiled = genome.tiles(spark.createDataFrame([("a", seq)], "contig string, seq string"))
    rows = spark.createDataFrame([("a", s, p, p + 2) for p in (0, 3, 57, 100, 190, 197) for s in "+-"], "contig string, strand string, start int, end int")
    comp = str.maketrans("ACGT", "TGCA")
    for x in report.upstream(rows, tiled).collect():
        window, beyond = (seq[max(x.end - 60, 0) : x.end], seq[x.end : x.end + 10]) if x.strand == "+" else (seq[x.start : x.start + 60].translate(comp)[::-1], seq[max(x.start - 10, 0) : x.start].translate(comp)[::-1])
        assert (x.window, x.beyond) == (window, beyond), x


def brute_candidates(seq):
    for e in range(len(seq) - 1, 10, -1):
        w = seq[max(0, e - 54) : e]
        if w[-1] == "G" and w.count("G") >= 8:
            found = [(c, e - len(m.group())) for c, *kind in MOTIF_KINDS if (m := re.search(motif_pattern(*kind), w))]
            if found:
                best = min(c for c, _ in found)
                yield e, max(s for c, s in found if c == best), best, min(s for _, s in found)


def test_candidates_equal_plain_search(spark):
    r = random.Random(5)
    seqs = {str(i): "".join(r.choice("GGGGATC") for _ in range(n)) for i, n in enumerate([0, 5, 12, 60, 511, 512, 513, 566, 1500])}
    df = spark.createDataFrame(list(seqs.items()), "contig string, seq string")
    got = Counter((x.id, x.e, x.start, x.priority, x.far) for x in motif.candidates(df).collect())
    assert got == Counter((k, *c) for k, s in seqs.items() for c in brute_candidates(s)) and len(got) > 300


def test_retained_motifs(spark):
    seq = "AAGGGAGGGAGGGAGGGAAAAAAA" + "T" * 60 + "GGAGGAGGAGGAAAA"
    df = spark.createDataFrame([("x", seq)], "contig string, seq string")
    rows = {x.e: x for x in motif.retained(df).collect()}
    assert 17 in rows and rows[17].priority == 1 and rows[17].start == 2 and rows[17].flank_start == 0 and rows[17].flank_end == 67
    assert 16 not in rows  # the tract's other 3' ends are worse motifs and own nothing
    assert any(x.priority == 4 and x.e > 80 for x in rows.values())
    assert rows[17].motif == seq[2:17] and rows[17].seq5 == "AA" and rows[17].seq3 == seq[17:67]


@pytest.mark.parametrize("seq, claims, kept", [
    ("TTGGGGTT", [(4, 2), (5, 1), (6, 3)], {5, 6}),  # the better one takes the Gs, the one at the tract's end keeps what is past it
    ("TTGGGGTT", [(4, 2), (5, 3), (6, 3)], {4, 6}),
    ("TTGGGGTT", [(4, 1), (5, 2), (6, 3)], {4, 5, 6}),
    ("TTGGTGGTT", [(4, 3), (7, 1)], {7}),  # its first base past the end belongs to a better one
    ("TTGGTGGTT", [(4, 1), (7, 3)], {4, 7}),
    ("TTGGTGGTT", [(4, 1), (6, 3)], {4, 6}),
    ("TTGGTGGGT", [(4, 1), (6, 3)], {4}),  # all of the next tract is taken over
    ("TTGGTTGGTT", [(4, 3), (8, 1)], {4, 8}),
])
def test_tract_owners(seq, claims, kept):
    found = np.array([(e, 0, c, 0) for e, c in claims])
    assert set(motif.owners(seq, found)[:, 0].tolist()) == kept


def test_alignment_filters_and_blocks(spark):
    rows = [("a", 0, 255, 1, "c", 100, "10M2I5M3D4M100N6M5S", "25"), ("b", 16, 3, 1, "c", 5, "5S10M", "0A9"), ("c", 16, 3, 1, "c", 5, "10M5S", "10"), ("d", 0, 3, 2, "c", 5, "10M", "10"), ("e", 0, 255, 1, "c", 5, "5S10M", "10"), ("f", 0, 255, None, "c", 5, "10=", "10"), ("g", 1024, 255, 1, "c", 5, "10M", "10")]
    df = spark.createDataFrame(rows, "qname string, flag int, mapq int, nh int, contig string, pos int, cigar string, md string")
    got = {x.qname for x in df.where(alignments.keeps_flag("SE") & alignments.is_unique() & alignments.five_prime_is_sound()).collect()}
    assert got == {"a", "b"}
    b = sorted((x.start, x.end, x.ord, x.strand) for x in alignments.blocks(df.where("qname = 'a'")).collect())
    assert b == [(100, 110, 1, "+"), (110, 115, 2, "+"), (118, 122, 3, "+"), (222, 228, 4, "+")]
    back = alignments.blocks(df.where("qname = 'a'").withColumn("flag", F.lit(16)))
    assert sorted((x.start, x.ord) for x in back.collect()) == [(100, 4), (110, 3), (118, 2), (222, 1)]


def test_annotation(spark):
    exons = spark.createDataFrame([("t", "c", "-", 0, 10, 3), ("t", "c", "-", 20, 30, 2), ("t", "c", "-", 40, 50, 1), ("u", "c", "+", 0, 10, 2), ("u", "c", "+", 20, 30, 2)], "transcript_id string, contig string, strand string, start int, end int, n int")
    numbered = annotation.numbered(exons, "n")
    assert {(x.transcript_id, x.start): x.number for x in numbered.collect()} == {("t", 0): 3, ("t", 20): 2, ("t", 40): 1, ("u", 0): 1, ("u", 20): 2}
    j = {(x.transcript_id, x.number, x.intron_start, x.intron_end) for x in annotation.junctions(numbered).collect()}
    assert j == {("t", 1, 30, 40), ("t", 2, 10, 20), ("u", 1, 10, 20)}
    cds = spark.createDataFrame([("t", 25, 30), ("t", 40, 45)], "transcript_id string, start int, end int")
    utr = {(x.region, x.start, x.end) for x in annotation.untranslated(exons, cds).collect()}
    assert utr == {("3UTR", 0, 10), ("3UTR", 20, 25), ("5UTR", 45, 50)}
    contigs = spark.createDataFrame([("c", "".join("ACGT"[i % 4] for i in range(60)))], "contig string, seq string")
    sequences = annotation.transcript_sequences(numbered, genome.tiles(contigs))
    s = {x.transcript_id: x.seq for x in sequences.collect()}
    g, comp = contigs.collect()[0].seq, str.maketrans("ACGT", "TGCA")
    assert s["u"] == g[:10] + g[20:30] and s["t"] == (g[:10] + g[20:30] + g[40:50]).translate(comp)[::-1]
    w = {(x.transcript_id, x.stop): (x.pos, x.window) for x in annotation.junction_windows(numbered, sequences).collect()}
    # Every base of the next exon that has ten bases before it, its first one included.
    assert {k[1] for k in w if k[0] == "u"} == set(range(10, 20)) and {k[1] for k in w if k[0] == "t"} == set(range(10, 30))
    assert w["u", 10] == (20, s["u"][:10]) and w["u", 19] == (29, s["u"][9:19]) and w["t", 10] == (29, s["t"][:10]) and w["t", 29] == (0, s["t"][19:29])


def test_short_exons_are_crossed_as_a_chain(spark):
    parts = [(0, 4), (10, 13), (20, 26), (40, 60), (70, 75)]
    exons = spark.createDataFrame([("t", "c", "+", s, e) for s, e in parts], "transcript_id string, contig string, strand string, start int, end int")
    numbered = annotation.numbered(exons)
    r = random.Random(2)
    contigs = spark.createDataFrame([("c", "".join(r.choice("ACGT") for _ in range(100)))], "contig string, seq string")
    sequences = annotation.transcript_sequences(numbered, genome.tiles(contigs))
    places = [p for s, e in parts for p in range(s, e)]
    got = {(x.stop, x.pos) for x in annotation.junction_windows(numbered, sequences).collect()}
    assert got == {(i, places[i]) for i in [*range(10, 23), *range(33, 38)]}


def test_annotation_types_and_rollup(spark):
    kinds = ["gene", "pseudogene", "mRNA", "D_gene_segment", "J_gene_segment", "ncRNA", "miRNA", "SRP_RNA", "exon", "CDS"]
    gff = spark.createDataFrame([("c", k, 0, 9, "+", {"ID": k, "Parent": "p"}) for k in kinds] + [("c", "gene", 0, 9, "+", {"ID": "x_PAR_Y"})], "contig string, type string, start int, end int, strand string, attrs map<string,string>")
    assert {(x.feature_id, x.kind) for x in annotation.features(gff).collect()} == {("gene", "gene"), ("pseudogene", "gene"), ("mRNA", "transcript"), ("D_gene_segment", "transcript"), ("J_gene_segment", "transcript"), ("exon", "exon"), ("CDS", "cds")}
    rows = [("g1", "N", "NM_2", ["CDS"]), ("g1", "N", "XM_1", []), ("g2", "gene-x", "NR_1", []), ("g1", "N", "NM_1", ["3UTR"])]
    hit = spark.createDataFrame([(1, *x) for x in rows], "k int, gene_id string, gene_name string, transcript_id string, regions array<string>")
    assert tuple(annotation.rollup(hit, ["k"]).collect()[0]) == (1, "N|g1;gene-x", "NM_1;NM_2;NR_1;XM_1", "3UTR;CDS;non_coding")
    assert annotation.rollup(hit, ["k"], True).collect()[0].transcript_ids == "NM_1;NM_2"


def test_sites(spark):
    hits = spark.createDataFrame([("K", 1, "c", "+", 10, 11), ("K", 2, "c", "+", 12, 13), ("KPDS", 1, "c", "+", 13, 14), ("K", 1, "c", "+", 16, 17), ("K", 1, "c", "-", 11, 12)], "cond string, rep int, contig string, strand string, start int, end int").withColumn("cov_t", F.lit(9).cast("long"))
    found = sites.site_islands(hits)
    assert {(x.strand, x.start, x.end, tuple(x.ids)) for x in found.collect()} == {("+", 10, 14, (1, 2, 10)), ("+", 16, 17, (1,)), ("-", 11, 12, (1,))}
    assert found.where(sites.is_supported(F.col("ids"))).count() == 1 and found.where(sites.is_supported(F.col("ids"), False)).count() == 1
    assert {x.coverage for x in sites.site_coverage(found, hits).collect()} == {9}


def test_components_and_places(spark):
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(30)], "node string")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)], "a string, b string")
    roots = {x.node: x.root for x in motif.component_roots(nodes, edges).collect()}
    assert all(roots[f"n{i:02d}"] == ("n00" if i <= 20 else f"n{i:02d}") for i in range(30))
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{(i + 1) % 200:03d}") for i in range(200)], "a string, b string")
    assert {x.root for x in motif.component_roots(spark.createDataFrame([(f"n{i:03d}",) for i in range(200)], "node string"), chain).collect()} == {"n000"}
    motifs = spark.createDataFrame([("t", 0, 5, 15, 19)], "id string, flank_start int, start int, e int, flank_end int")
    tx = spark.sql("SELECT 't' id, 'c' contig, '-' strand, array(named_struct('start', 40, 'end', 50), named_struct('start', 20, 'end', 30), named_struct('start', 18, 'end', 20)) exons")
    row = motif.placed(motifs, tx).collect()[0]
    as_pairs = lambda x: [(p.start, p.end) for p in x]
    assert as_pairs(row.pieces) == [(40, 45), (25, 30)] and as_pairs(row.left) == [(45, 50)] and as_pairs(row.right) == [(21, 25)]
    touching = motif.placed(motifs.withColumn("e", F.lit(21)).withColumn("flank_end", F.lit(21)), tx).collect()[0]
    assert as_pairs(touching.pieces) == [(40, 45), (19, 30)] and as_pairs(touching.right) == []


def test_choice_of_motifs(spark):
    """Best class that contains the site, then the 3'-most place, then the flank that suits."""
    cols = "motif_id int, serial int, contig string, strand string, start int, end int, pieces array<struct<start:int,end:int>>, right array<struct<start:int,end:int>>, priority int, class string"
    rows = [
        (1, 1, "c", "+", 0, 0, [(10, 20), (40, 50)], [(50, 60)], 2, "b"),
        (2, 2, "c", "+", 0, 0, [(10, 20), (40, 50)], [(50, 52), (80, 99)], 2, "b"),
        (3, 3, "c", "+", 0, 0, [(30, 49)], [(49, 60)], 2, "b"),
        (4, 4, "c", "+", 0, 0, [(20, 50)], [(70, 80)], 1, "a"),  # does not contain a site that runs past its end
        (5, 5, "c", "+", 0, 0, [(30, 50)], [], 3, "c"),
    ]
    motifs = spark.createDataFrame(rows, cols)
    pick = lambda s, e: [(x.motif_id) for x in motif.representative(motif.best_locus(motif.best_class(motif.near_sites(spark.createDataFrame([("c", "+", s, e)], "contig string, strand string, start int, end int"), motifs), sites.SITE), sites.SITE), sites.SITE).collect()]
    assert pick(49, 51) == [2] and pick(48, 49) == [4] and pick(53, 54) == []
    zones = {(x.motif_id, x.z_start, x.z_end) for x in motif.zones(motifs).collect()}
    assert {z for z in zones if z[0] in (2, 5)} == {(2, 47, 50), (2, 50, 53), (5, 47, 50)}
    minus = motif.zones(motifs.where("motif_id = 2").withColumn("strand", F.lit("-")).withColumn("pieces", F.expr("array(named_struct('start', 40, 'end', 50), named_struct('start', 10, 'end', 20))")).withColumn("right", F.expr("array(named_struct('start', 5, 'end', 10))")))
    assert {(x.z_start, x.z_end) for x in minus.collect()} == {(40, 43), (7, 10)}  # of the first piece, as the method does


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan; the overlap join is keyed on more than the contig."""
    spark.range(10).selectExpr("'c' contig", "'+' strand", "CAST(id AS INT) start", "CAST(id + 5 AS INT) end", "1 ord", "'x' junk").write.parquet(f"{tmp_path}/b")
    df = spark.read.parquet(f"{tmp_path}/b")
    plan = pileup.pileup(df.where("strand = '+'"))._jdf.queryExecution().executedPlan().toString()
    assert "junk" not in plan and "EqualTo(strand,+)" in plan and "partial_sum" in plan
    joined = intervals.overlap_join(df, df.withColumnsRenamed({"start": "r_start", "end": "r_end"}), 16)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in joined and "Cartesian" not in joined


def test_no_exchange_on_contig_alone(spark):
    """Sequence is looked up by contig and tile, islands are made within tiles."""
    tiled = genome.tiles(spark.createDataFrame([("a", "ACGT" * 50)], "contig string, seq string"))
    rows = spark.createDataFrame([("a", "+", 1, 2, 1)], "contig string, strand string, start int, end int, pos int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (report.upstream(rows, tiled), signal.next_base(rows, tiled), genome.windows(rows, tiled, 10)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"hashpartitioning\(contig#\d+, tile#\d+", plan) and not re.search(r"hashpartitioning\(contig#\d+, \d+\)", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_blocks_are_shuffled_once_and_bases_never(spark):
    """Pile-ups and pairs deal out blocks by keys and bin; what follows stays where it is."""
    df = spark.range(10).selectExpr("concat('c', id % 3) contig", "IF(id % 5 = 0, '-', '+') strand", "IF(id % 2 = 0, 'Li', 'K') cond", "CAST(id % 2 AS INT) rep", "CAST(id AS INT) start", "CAST(id + 5 AS INT) end", "1 ord")
    for out in (pileup.pileup(df, ["contig", "strand", "cond", "rep"]), signal.pairs_of_blocks(df, ["contig", "strand", "rep"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and re.search(r"hashpartitioning\([^)]*bin#", plan)


def test_runs_in_arrays(spark):
    got = spark.sql("SELECT array(5, 4, 9, 4, 7, 8) p UNION ALL SELECT array(3) UNION ALL SELECT CAST(array() AS ARRAY<INT>)").select(intervals.runs_in(F.col("p")).alias("r")).collect()
    assert sorted([tuple(x) for x in r.r] for r in got) == [[], [(3, 4)], [(4, 6), (7, 10)]]


def test_whitelisted_runs_of_whole_contigs(spark):
    """As by a row for each position; runs go on over edges of tiles, and contigs may end anywhere near one."""
    rng = random.Random(5)
    seqs = [(f"r{n}", "".join(rng.choice("ACGGT") for _ in range(n))) for n in (0, 5, 10, 11, 12, 4096, 4097, 4106, 4107, 4300, 9000)]
    seqs += [("all", "G" * 13000), ("none", "A" * 5000), ("split", "A" * 4080 + "GGG" * 20 + "A" * 100)]
    tiled = genome.tiles(spark.createDataFrame(seqs, "contig string, seq string"))
    want = sorted(tuple(x) for x in intervals.runs_of_positions(catalog.white(tiled), ["contig"]).select("contig", "start", "end").collect())
    assert sorted(tuple(x) for x in genome.whitelisted_runs(tiled, 10).collect()) == want
    assert ("all", 10, 13000) in want


def test_tables_that_follow_the_input_are_not_broadcast(spark):
    """Not even those that Spark takes for small: their files may be, and what is exploded from them not."""
    exons = spark.range(4).selectExpr("concat('t', id % 2) transcript_id", "'g' gene_id", "concat('c', id % 2) contig", "'+' strand", "CAST(id * 10 AS INT) start", "CAST(id * 10 + 5 AS INT) end")
    numbered = annotation.numbered(exons)
    seqs = exons.selectExpr("transcript_id", "'ACGT' seq")
    tx = annotation.spliced(numbered).withColumnsRenamed({"transcript_id": "id"}).withColumn("gene_id", F.lit("g"))
    found = exons.selectExpr("transcript_id id", "start far", "end e", "start", "start flank_start", "end flank_end")
    places = motif.cluster_places(found, tx)
    motifs = exons.selectExpr("transcript_id motif_id", "contig", "strand", "start", "end", "array(struct(start, end)) pieces", "array(struct(start, end)) right")
    points = exons.selectExpr("contig", "strand", "start pos")
    outs = [
        annotation.untranslated(exons, exons), annotation.junction_windows(numbered, seqs), annotation.transcript_sequences(numbered, genome.tiles(seqs.withColumnsRenamed({"transcript_id": "contig"}))),
        annotation.with_regions(exons.select("transcript_id"), exons.withColumn("region", F.lit("CDS"))), motif.placed(found, tx), places, motif.overlapping_clusters(places), motif.alike_clusters(places),
        motif.cluster_links(places), motif.near_sites(exons, motifs), intervals.points_within(points, exons, 64),
    ]
    for out in outs:
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
