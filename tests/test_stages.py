"""Sorted files, stored stages, the report's order, clusters of motifs, exact bootstraps, the sorted stream."""

import gzip
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallmap.functions import genome
from stallmap.jobs import pipeline, stages
from stallmap.operators import cutoff, motif, pileup, report, signal
from stallmap.sources import fasta, tables, text
from stallmap.streaming.pileup import sorted_pileup
from test_job import made_up


def joined(folder, names) -> list[str]:
    """The lines of files, one after the other."""
    out = b""
    for n in names:
        data = open(f"{folder}/{n}", "rb").read()
        out += gzip.decompress(data) if n.endswith(".gz") else data
    return out.decode().splitlines()


# ---- sinks ----


def test_a_contig_is_many_sorted_files(spark, tmp_path):
    r = random.Random(1)
    rows = [("K", 1, "hot" if r.random() < 0.9 else f"c{r.randint(0, 5)}", r.choice("+-"), r.randint(0, 10**6)) for _ in range(6000)]
    rows = list({x[2:]: x for x in rows}.values())
    df = spark.createDataFrame(rows, "cond string, rep int, contig string, strand string, pos int").withColumns({"cov": F.lit(3), "rss": F.lit(1)}).repartition(6)
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        tables.write_pileup(df, f"{tmp_path}/p", ("cond", "rep"))
        bed = df.select("contig", F.col("pos").alias("start"), (F.col("pos") + 3).alias("end"), "strand")
        tables.write_bed(bed, f"{tmp_path}/bed")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    found = tables.manifest(spark, f"{tmp_path}/p")
    assert sum(n for _, n in found) == sum(os.path.getsize(f"{tmp_path}/p/{n}") for n, _ in found)
    hot = 0
    for strand in "+-":
        own = [n for n, _ in found if f"strand_={'%2B' if strand == '+' else strand}/" in n or f"strand_={strand}/" in n]
        lines = [x.split("\t") for x in joined(f"{tmp_path}/p", own)]
        places = [(x[0], int(x[1])) for x in lines]
        assert places == sorted((x[2], x[4]) for x in rows if x[3] == strand)
        hot += sum(any(x.startswith("hot\t") for x in joined(f"{tmp_path}/p", [n])) for n in own)
    assert hot >= 3
    lines = [x.split("\t") for x in joined(f"{tmp_path}/bed", [n for n, _ in tables.manifest(spark, f"{tmp_path}/bed")])]
    assert [(x[0], x[5], int(x[1])) for x in lines] == sorted((x[2], x[3], x[4]) for x in rows)
    assert Counter(map(tuple, tables.read_pileup(spark, f"{tmp_path}/p").select("cond", "rep", "contig", "strand", "pos").collect())) == Counter(rows)
    with pytest.raises(ValueError, match="strand_"):
        tables.write_pileup(df.withColumn("strand_", F.lit(1)), f"{tmp_path}/x", ("cond", "strand_"))


def test_no_sink_deals_by_contig_alone(spark, tmp_path):
    df = spark.createDataFrame([("c", "+", 1, 2)], "contig string, strand string, start int, end int")
    plan = tables.in_ranges(df, "contig", "strand", "start")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(contig#" in plan and "start#" in plan.split("rangepartitioning(")[1].split(")")[0] and "hashpartitioning" not in plan


def test_cluster_files(spark, tmp_path):
    kinds = "contig string, start int, end int, gene_name string, gene_id string, `group` int, strand string, members array<struct<node:string,id:string,regions:array<string>,pieces:array<struct<start:int,end:int>>>>"
    rows = [("c:1", 5, 40, "G", "g1", 0, "-", [("t1#1", "t1", ["CDS", "3UTR"], [(30, 40), (5, 9)]), ("t2#1", "t2", [], [(5, 12)])]), ("c", 1, 3, "N", "g2", 1, ".", [("t3#2", "t3", ["CDS"], [(1, 3)])])]
    tables.write_clusters(spark.createDataFrame(rows, kinds), f"{tmp_path}/c")
    back = {x.name: x for x in tables.read_clusters(spark, f"{tmp_path}/c").collect()}
    x = back["G|g1"]
    assert (x.contig, x.start, x.end, x.group, x.strand) == ("c:1", 5, 40, 0, "-") and back["N|g2"].strand == "."
    assert [(m.id, m.regions, [tuple(p) for p in m.pieces]) for m in x.members] == [("t1", ["CDS", "3UTR"], [(30, 40), (5, 9)]), ("t2", [], [(5, 12)])]


# ---- stages ----


def test_stage_manifest(spark, tmp_path):
    (tmp_path / "in").write_text("x")
    path, source = f"{tmp_path}/s", f"{tmp_path}/in"
    of = stages.fingerprint(spark, {"a": 1}, [source])
    assert not stages.holds(spark, path, of)
    spark.range(5).write.parquet(path)
    assert not stages.holds(spark, path, of)  # written, but not said to be whole
    stages.commit(spark, path, of)
    assert stages.holds(spark, path, of) and spark.read.parquet(path).count() == 5
    assert not stages.holds(spark, path, stages.fingerprint(spark, {"a": 2}, [source]))
    assert stages.fingerprint(spark, {"a": 1}, [source]) == of
    (tmp_path / "in").write_text("xy")
    assert stages.fingerprint(spark, {"a": 1}, [source]) != of
    part = next(n for n in os.listdir(path) if n.endswith(".parquet"))
    os.rename(f"{path}/{part}", f"{tmp_path}/away")
    assert not stages.holds(spark, path, of)
    os.rename(f"{tmp_path}/away", f"{path}/{part}")
    assert stages.holds(spark, path, of)
    open(f"{path}/{stages.MANIFEST}", "w").write("{")
    assert not stages.holds(spark, path, of)
    stages.clear(spark, path)
    assert not os.path.exists(path)


def test_changed_inputs_rerun_what_depends_on_them(spark, tmp_path, monkeypatch):
    samples = made_up(tmp_path, reps=(1,), kinds=("Li", "K"))
    config = pipeline.Config(str(tmp_path / "g.fa"), [("a", str(tmp_path / "a.gff"))], samples, folder=str(tmp_path / "out"))
    made = []
    for name in ("whitelist", "motifs_of", "clusters_of", "read_blocks"):
        monkeypatch.setattr(pipeline, name, lambda *x, f=getattr(pipeline, name), n=name: made.append(n) or f(*x))

    def run() -> tuple[list[str], Counter]:
        made.clear()
        rows = pipeline.signals(spark, config).select("cond", "strand", "pos", "rss_t").collect()
        _, _, white, motifs = pipeline.prepare(spark, config)
        return sorted(made), Counter(map(str, [*rows, *white.select("strand", "start", "end").collect(), *motifs.select("start", "end", "sequence", "nth").collect()]))

    first, rows = run()
    assert first == ["clusters_of", "motifs_of", "read_blocks", "whitelist"] and len(rows) > 10
    assert run() == ([], rows)
    os.utime(tmp_path / "K1.sam", (1, 1))
    os.remove(tmp_path / "out/sample.a.motif.bed" / stages.MANIFEST)  # as if it had been left half-written
    assert run() == (first, rows)
    os.utime(tmp_path / "a.gff", (1, 1))
    assert run() == (first[:2] + first[3:], rows)
    assert tables.read_clusters(spark, config.path("a.cluster.bed")).where("strand = '+' and size(members) >= 1").count() >= 1


# ---- the report ----


def test_report_is_in_order(spark, tmp_path):
    r = random.Random(4)
    names = ["chr10", "chr2", "b,c", 'q"d', "chrM"]
    rows = [(r.choice(names), s, s + 1, "x", 5, r.choice("+-"), "i", "False", "line one\n line, two ", "N/A") for s in r.sample(range(10**6), 900)]
    from stallmap.constants import REPORT_COLUMNS

    kinds = [f"{c} {'int' if c in ('start', 'end', 'avg_sequencing_coverage') else 'string'}" for c in REPORT_COLUMNS]
    df = spark.createDataFrame(rows, ", ".join([*kinds, "a_gene_names string"])).repartition(5)
    ranks = spark.createDataFrame([("chr2", 1), ("chr10", 2), ("chrM", 3)], "contig string, place int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        report.write_csv(df, f"{tmp_path}/r", ranks)
        report.write_csv(df.limit(0), f"{tmp_path}/none", ranks)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    files = [n for n, _ in tables.manifest(spark, f"{tmp_path}/r")]
    assert len(files) >= 3
    (tmp_path / "one.csv").write_bytes(b"".join(open(f"{tmp_path}/r/{n}", "rb").read() for n in files))
    import csv

    with open(tmp_path / "one.csv", newline="") as f:
        read = list(csv.reader(f))
    place = {"chr2": 1, "chr10": 2, "chrM": 3}
    want = sorted(rows, key=lambda x: (place.get(x[0], 9), x[0], x[5], x[1]))
    assert read[0] == [*REPORT_COLUMNS, "a_gene_names"] and read[1:] == [list(map(str, x)) for x in want]
    back = report.read_csv(spark, f"{tmp_path}/r")
    assert back.columns == df.columns and Counter(map(tuple, back.collect())) == Counter(tuple(map(str, x)) for x in rows)
    assert report.read_csv(spark, f"{tmp_path}/none").count() == 0


# ---- annotation and genome ----


def test_annotation_of_some_contigs_and_zipped(spark, tmp_path):
    line = "{}\ts\tgene\t{}\t{}\t.\t+\t.\tID=g{};Name=n\n"
    data = [line.format(f"c{i % 3}", i, i + 5, i) for i in range(1, 40)]
    with open(tmp_path / "a.gff.gz", "wb") as f:  # of several members
        f.write(gzip.compress("#head\n".encode()) + b"".join(gzip.compress("".join(data[k : k + 7]).encode()) for k in range(0, len(data), 7)))
    got = text.gff(spark, f"{tmp_path}/a.gff.gz").collect()
    assert {(x.contig, x.start, x.attrs["ID"]) for x in got} == {(f"c{i % 3}", i - 1, f"g{i}") for i in range(1, 40)}
    some = text.gff(spark, f"{tmp_path}/a.gff.gz", ["c1", "c9"])
    assert {x.contig for x in some.collect()} == {"c1"} and some.count() == 13
    plan = some._jdf.queryExecution().executedPlan().toString()
    below = [x for x in plan.splitlines() if "Filter (" in x][-1]
    assert "substring_index(value" in below.partition("split(value")[0]  # conditions are tried in order


@pytest.mark.parametrize("read", [7, 64, 1 << 20])
def test_lines_of_ranges(tmp_path, monkeypatch, read):
    """What is said of lines doesn't depend on how many bytes are read at a time."""
    monkeypatch.setattr(fasta, "READ", read)
    r = random.Random(8)
    data = "".join(f">n{i} a>b\n" + "".join("ACGT"[: r.choice([1, 3, 4])] * 5 + r.choice(["\n", "\r\n"]) for _ in range(r.randint(0, 9))) for i in range(12))
    (tmp_path / "g.fa").write_text(data, newline="")
    for part in (9, 50, 10_000):
        reader = fasta.LineReader({"path": f"file://{tmp_path}/g.fa", "partbytes": str(part)})
        found = [x for p in reader.partitions() for x in reader.read(p)]
        assert [x[1] for x in found if x[1] is not None] == [f"n{i}" for i in range(12)]
        lines = [x for x in data.replace("\r", "").split("\n") if x and x[0] != ">"]
        assert sum(x[3] for x in found) == sum(map(len, lines)) and sum(x[-1] for x in found) == len(lines)


# ---- cutoffs ----


def test_an_alpha_without_positives_is_not_chosen(spark):
    rows = [(0, 0.1, True)] * 10 + [(0, 0.1, False)] * 6 + [(3, 0.05, False)]
    labelled = spark.createDataFrame(rows, "k int, alpha double, positive boolean")
    assert {x.k for x in cutoff.curve(labelled).collect()} == {0}
    chosen = cutoff.chosen(cutoff.best(cutoff.curve(labelled), 0.01), 0.01).collect()[0]
    assert chosen.first_alpha == 0.2 and chosen.n_pos == 10
    assert cutoff.chosen(cutoff.best(cutoff.curve(labelled.where("k = 3")), 0.01), 0.01).count() == 0


# ---- motifs ----


@pytest.mark.parametrize("strand, zones", [("+", {(17, 20)}), ("-", {(5, 8)})])
def test_an_empty_flank_has_no_zone(spark, strand, zones):
    pieces = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([("c", strand, [(5, 20)], [])], f"contig string, strand string, pieces {pieces}, `right` {pieces}")
    assert {(x.z_start, x.z_end) for x in motif.zones(df).collect()} == zones


def owners_by_cells(seq: str, found: np.ndarray) -> set[int]:
    """Motifs from the right end on; each claims cells from one past its end leftwards. A free cell is taken; one of a worse class is taken
    over with the Gs that follow it; one of an equal or better class ends the claim, and so does a base other than G more than one before the end."""
    cells: dict[int, tuple[int, int]] = {}
    for e, _, rank, _ in sorted(found.tolist(), reverse=True):
        for cell in range(e + 1, -1, -1):
            if cell < e - 1 and seq[cell] != "G":
                break
            if cell >= len(seq):
                continue
            if cell in cells and cells[cell][0] <= rank:
                break
            more = cell + 1
            if cell in cells:
                while more < len(seq) and seq[more] == "G":
                    more += 1
            cells |= dict.fromkeys(range(cell, more), (rank, e))
    return {e for _, e in cells.values()}


@pytest.mark.parametrize("letters", ["GGGGATC", "GGGGGGGA", "GGGAT", "GGT", "GGGGGGGGGGC"])
def test_owners_are_those_of_a_walk_over_cells(letters):
    r = random.Random(len(letters))
    n = 0
    for _ in range(400):
        seq = "".join(r.choice(letters) for _ in range(r.choice([15, 30, 80, 200])))
        found = motif.found_in([seq])[0]
        assert set(motif.owners(seq, found)[:, 0].tolist()) == owners_by_cells(seq, found), seq
        n += len(found)
    assert n > 400
    # Any classes at any ends of tracts, not only those that a search gives.
    for _ in range(400):
        seq = "".join(r.choice(letters) for _ in range(40))
        ends = [e for e in range(1, 40) if seq[e - 1] == "G" and r.random() < 0.6]
        found = np.array([(e, 0, r.randint(1, 4), 0) for e in ends], np.int64).reshape(-1, 4)
        assert set(motif.owners(seq, found)[:, 0].tolist()) == owners_by_cells(seq, found), (seq, found.tolist())


def places_of(spark, seed: int, n: int = 150):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choice([r.randint(0, 3000), 250, 255, 1020])
        pieces = []
        for _ in range(r.randint(1, 3)):
            pieces.append((s, s + r.choice([1, 5, 30, 600])))
            s = pieces[-1][1] + r.choice([0, 1, 40])
        rows.append((r.choice(["g1", "g1", "g2"]), r.choice(["c", "d"]), r.choice("+-"), f"n{i:03d}", pieces))
    rows += [("hot", "c", "+", f"h{i:03d}", [(100, 130), (200, 210)]) for i in range(60)] + [("hot", "c", "+", "h900", [(209, 215)]), ("hot", "c", "+", "h901", [(215, 220)])]
    return rows, spark.createDataFrame(rows, "gene_id string, contig string, strand string, node string, pieces array<struct<start:int,end:int>>")


@pytest.mark.parametrize("width", [1, 64, 100_000])
def test_clusters_that_overlap(spark, width):
    rows, df = places_of(spark, width)
    meet = {(a[3], b[3]) for a in rows for b in rows if a[:3] == b[:3] and a[3] < b[3] and any(x[0] < y[1] and y[0] < x[1] for x in a[4] for y in b[4])}
    alike = {x.node: x.rep for x in motif.alike_clusters(df).collect()}
    least = {}
    for x in sorted(rows, key=lambda x: x[3]):
        least.setdefault((*x[:3], tuple(x[4])), x[3])
    assert alike == {x[3]: least[*x[:3], tuple(x[4])] for x in rows}
    pairs = [(x.a, x.b) for x in motif.overlapping_clusters(df, width).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {p for p in meet if all(alike[x] == x for x in p)}
    links = motif.cluster_links(df, width)
    root = {x[3]: x[3] for x in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in meet:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in motif.component_roots(df.select("node"), links).collect()}
    assert got == {x: find(x) for x in root}
    if width > 1:
        assert links.count() < 4 * sum(len(x[4]) for x in rows)  # no pairs of a crowded place
    groups = motif.cluster_groups(df, spark.createDataFrame(list(got.items()), "node string, root string")).collect()
    for g in groups:
        own = [x for x in rows if got[x[3]] == g.root]
        assert (g.start, g.end, g.n) == (min(p[0] for x in own for p in x[4]), max(p[1] for x in own for p in x[4]), len(own)) and [m.node for m in g.members] == sorted(x[3] for x in own)
    by = {}
    for g in groups:
        by.setdefault(g.gene_id, []).append((g.group, g.start))
    assert all([n for n, _ in sorted(x)] == list(range(len(x))) and sorted(x) == sorted(x, key=lambda y: y[0]) for x in by.values())


def test_groups_over_both_strands(spark):
    df = spark.createDataFrame([("g", "c", "+", "a", [(1, 5)]), ("g", "c", "-", "b", [(3, 9)])], "gene_id string, contig string, strand string, node string, pieces array<struct<start:int,end:int>>")
    roots = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, root string")
    assert [(x.start, x.end, x.strand, x.n) for x in motif.cluster_groups(df, roots).collect()] == [(1, 9, ".", 2)]


# ---- bootstraps ----


def test_bootstraps_draw_as_many_as_there_are(spark):
    reads = spark.createDataFrame([("K" if i < 3000 else "Li", 1, i) for i in range(3500)] + [("K", 2, 7)], "cond string, rep int, read_id long")
    got = pileup.bootstrap_draws(reads, 12, group=400)
    rows = [tuple(x) for x in got.collect()]
    total = Counter()
    for c, r, b, i, n in rows:
        total[c, r, b] += n
        assert n > 0
    assert total == {(c, r, b): n for c, r, n in (("K", 1, 3000), ("Li", 1, 500), ("K", 2, 1)) for b in range(1, 13)}
    assert len({x[:4] for x in rows}) == len(rows)
    # The same, however rows are dealt.
    assert Counter(map(tuple, pileup.bootstrap_draws(reads.repartition(7), 12, group=400).collect())) == Counter(rows)
    assert Counter(map(tuple, pileup.bootstrap_draws(reads, 12, group=400, seed=1).collect())) != Counter(rows)
    # Copies are spread as draws with replacement are: mean 1, deviation 1, and bootstraps and groups are independent.
    copies = np.zeros((12, 3000))
    for c, r, b, i, n in rows:
        if (c, r) == ("K", 1):
            copies[b - 1, i] = n
    assert abs(copies.var() - 1) < 0.05 and abs((copies == 0).mean() - np.exp(-1)) < 0.01
    assert np.abs(np.corrcoef(copies)[np.triu_indices(12, 1)]).max() < 0.09
    assert abs(copies.sum(axis=0).var() - 12) < 1.2


def test_bootstraps_go_through_the_pile_up(spark):
    r = random.Random(2)
    rows = [(cond, 1, i + 1000 * k, "c", "+", s, s + 20, 1) for k, cond in enumerate(("Li", "K")) for i in range(300) for s in [r.choice([r.randint(0, 60), 30])]]
    blocks = spark.createDataFrame(rows, "cond string, rep int, read_id long, contig string, strand string, start int, end int, ord int")
    with_copies = pileup.bootstrapped(blocks, 3)
    piled = pileup.pileup(with_copies, ["contig", "strand", "cond", "rep", "bootstrap"], "copies")
    assert {(x.cond, x.bootstrap): x.n for x in piled.groupBy("cond", "bootstrap").agg(F.sum("rss").alias("n")).collect()} == {(c, b): 300 for c in ("Li", "K") for b in (1, 2, 3)}
    paired = signal.pairs_of_blocks(with_copies, ["contig", "strand", "rep", "bootstrap"], weight="copies")
    other = signal.pairs(piled.where("cond = 'K'"), piled.where("cond = 'Li'").drop("cond"), ["contig", "strand", "rep", "bootstrap"])
    same = lambda df: Counter(map(tuple, df.select("bootstrap", "pos", "cov_t", "rss_t", "cov_c", "rss_c").collect()))
    assert same(paired) == same(other) and len(same(paired)) > 100


# ---- the sorted stream ----

BLOCK = "cond string, rep int, rank int, contig string, strand string, at int, start int, end int, ord int"


def reads_of(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for cond in ("Li", "K"):
        for rank, contig in ((0, "x"), (2, "a"), (3, "m")):
            for at in sorted(r.choice([r.randint(0, 400), 50, 5000]) for _ in range(120)):
                strand, s = r.choice("+-"), at
                parts = [(s, s + r.randint(1, 30))]
                if r.random() < 0.3:  # over an intron
                    parts.append((parts[0][1] + r.randint(1, 200), 0))
                    parts[1] = (parts[1][0], parts[1][0] + r.randint(1, 20))
                order = range(len(parts), 0, -1) if strand == "-" else range(1, len(parts) + 1)
                rows += [(cond, 1, rank, contig, strand, at, a, b, k) for (a, b), k in zip(parts, order)]
    return sorted(rows, key=lambda x: (x[2], x[5]))


def run_stream(spark, tmp_path, batches, name):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, BLOCK).coalesce(1).write.parquet(f"{tmp_path}/{name}-in/{k}")
    # A folder for each batch, taken in order of their times.
    for k in range(len(batches)):
        for n in os.listdir(f"{tmp_path}/{name}-in/{k}"):
            os.utime(f"{tmp_path}/{name}-in/{k}/{n}", (1000 + k, 1000 + k))
    stream = sorted_pileup(spark.readStream.schema(BLOCK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}-in/*"))
    run = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    run.awaitTermination(300)
    return run


def test_sorted_stream_gives_the_pile_up(spark, tmp_path):
    rows = reads_of(1)
    r = random.Random(5)
    cuts = [0, *sorted(r.sample(range(len(rows)), 4)), len(rows)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    for b in batches:
        r.shuffle(b)
    batches.append([(c, 1, None, None, None, None, None, None, None) for c in ("Li", "K")])
    run = run_stream(spark, tmp_path, batches, "sorted")
    keys = ["cond", "rep", "contig", "strand"]
    want = Counter(map(tuple, pileup.pileup(spark.createDataFrame(rows, BLOCK), keys).select(*keys, "pos", "cov", "rss").collect()))
    got = Counter(map(tuple, spark.table("sorted").select(*keys, "pos", "cov", "rss").collect()))
    assert got == want and max(got.values()) == 1
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(kept) == 2 and kept[-1] == 0  # a row for each sample, and none once they have ended


def test_disorder_in_a_sorted_stream_is_an_error(spark, tmp_path):
    rows = [x for x in reads_of(2) if x[0] == "K"]
    with pytest.raises(Exception, match="comes after"):
        run_stream(spark, tmp_path, [rows[100:200], rows[:100]], "disorder")
    assert genome.WIDTH > genome.REACH
