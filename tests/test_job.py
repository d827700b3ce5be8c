"""File sources, and the whole job on a small made-up genome."""

import os
import random
import struct
import zlib
from collections import Counter

import pytest

from stallmap.constants import REPORT_COLUMNS
from stallmap.jobs import pipeline
from stallmap.operators import report
from stallmap.sources import tables, text
from stallmap.sources.bam import Bam
from stallmap.storage import discard, job, materialize
from stallmap.streaming.pileup import running_pileup


def bgzf(data: bytes) -> bytes:
    out = b""
    for k in range(0, len(data), 50_000):
        part = data[k : k + 50_000]
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(part) + pack.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bam(records, order="coordinate") -> bytes:
    head = f"@HD\tVN:1.6\tSO:{order}\n".encode()
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000)
    for name, flag, mapq, pos, ops, nh, md in records:
        n = sum(k for k, op in ops if op in "MIS=X")
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, mapq, 0, len(ops), flag, n, -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", k << 4 | "MIDNSHP=X".index(op)) for k, op in ops) + bytes((n + 1) // 2 + n)
        body += b"XBBs" + struct.pack("<ihh", 2, 1, 2) + b"NHC" + bytes([nh]) + b"ASi" + struct.pack("<i", 5) + b"MDZ" + md.encode() + b"\0"
        data += struct.pack("<i", len(body)) + body
    return bgzf(data)


def test_bam(spark, tmp_path):
    records = [(f"r{i}", 16 * (i % 2), 255, i, [(5, "S"), (20, "M"), (7, "N"), (30, "M")], 1 + i % 3, "50") for i in range(2000)]
    (tmp_path / "a.bam").write_bytes(bam(records))
    spark.dataSource.register(Bam)
    rows = {x.qname: x for x in spark.read.format("bam").option("path", f"file://{tmp_path}").load().collect()}
    assert len(rows) == 2000 and tuple(rows["r7"]) == ("r7", 16, 255, 2, "c1", 7, "5S20M7N30M", "50")
    (tmp_path / "a.bam").write_bytes(bam(records[:3], "queryname"))
    with pytest.raises(Exception, match="sorted by coordinate"):
        spark.read.format("bam").option("path", f"file://{tmp_path}").load().count()


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 some words\nACGT\nacgt\n>c2\nGG\n")
    assert {(x.contig, x.seq) for x in text.fasta(spark, str(tmp_path / "g.fa")).collect()} == {("c1", "ACGTacgt"), ("c2", "GG")}
    gtf = 'c1\ts\texon\t5\t9\t.\t+\t.\tgene_id "g 1"; transcript_id "t1"; exon_number 2; tag "a"; tag "b"'
    (tmp_path / "a.gff").write_text("#x\nc1\ts\tgene\t1\t10\t.\t-\t.\tID=g1;Name=n;Dbxref=a:b,c\n" + gtf + "\n\n")
    rows = text.gff(spark, str(tmp_path / "a.gff")).collect()
    assert rows[0].start == 0 and rows[0].end == 10 and rows[0].attrs["ID"] == "g1" and rows[0].attrs["Dbxref"] == "a:b,c"
    assert rows[1].attrs["gene_id"] == "g 1" and rows[1].attrs["exon_number"] == "2" and rows[1].attrs["tag"] == "a"
    assert text.gff(spark, str(tmp_path / "a.gff"), ["c9"]).count() == 0
    (tmp_path / "a.bed").write_text("c1\t3\t9\t.\t0\t-\n")
    assert tuple(text.bed(spark, str(tmp_path / "a.bed")).collect()[0]) == ("c1", 3, 9, "-")


def made_up(folder, stops=(315, 600), reps=(1, 2), kinds=("Li", "K", "KPDS")):
    """A genome with a motif and stops in its 3' zone, and another stop on the first base after a junction."""
    r = random.Random(12)
    seq = [r.choice("ACT") for _ in range(1000)]
    seq[300:320] = "GGGAGGGAGGGAGGGTAGCT"
    seq[490:500] = "GGAGGACTGG"  # the end of the first exon
    (folder / "g.fa").write_text(">c1\n" + "".join(seq) + "\n>c2\nACGT\n")
    lines = [
        ("gene", 101, 900, "ID=gene1;Name=G"), ("mRNA", 101, 900, "ID=NM_1;Parent=gene1"), ("exon", 101, 500, "Parent=NM_1"), ("exon", 601, 900, "Parent=NM_1"), ("CDS", 151, 350, "Parent=NM_1"),
        ("gene", 301, 330, "ID=gene-D;Name=gene-D"), ("D_gene_segment", 301, 330, "ID=d1;Parent=gene-D"), ("exon", 301, 330, "Parent=d1"),
        ("gene", 301, 330, "ID=gene-J;Name=gene-J"), ("J_gene_segment", 301, 330, "ID=j1;Parent=gene-J"), ("exon", 301, 330, "Parent=j1"),
        ("miRNA", 301, 330, "ID=m1;Parent=gene-J"), ("exon", 301, 330, "ID=id-MIR7;Parent=m1"),
    ]
    (folder / "a.gff").write_text("\n".join(f"c1\ts\t{kind}\t{s}\t{e}\t.\t+\t.\t{a}" for kind, s, e, a in lines) + "\n")
    samples = []
    for cond in kinds:
        for rep in reps:
            rows = []
            for i in range(2400):
                at = stops[i % 2] if cond != "Li" and i % 3 == 0 else r.choice([r.randint(120, 440), r.randint(590, 640)])
                rows.append(f"q{i}\t0\tc1\t{at + 1}\t255\t50M\t*\t0\t0\t*\t*\tNH:i:1\tMD:Z:50")
            path = folder / f"{cond}{rep}.sam"
            path.write_text("@HD\tVN:1.6\tSO:coordinate\n" + "\n".join(rows) + "\n")
            samples.append((cond, rep, str(path)))
    return samples


def test_whole_job(spark, tmp_path):
    config = pipeline.Config(str(tmp_path / "g.fa"), [("refseq", str(tmp_path / "a.gff"))], made_up(tmp_path), folder=str(tmp_path / "out"))
    written = pipeline.main(spark, config)
    assert [x.rpartition("/")[2] for x in written] == ["sample.rG4_list.combined.csv", "sample.rG4_list.combined_breakdown.csv"]
    rows = {x.start: x for x in report.read_csv(spark, written[0]).collect()}
    assert set(rows) == {"315", "600"} and list(rows["315"].asDict())[:9] == list(REPORT_COLUMNS)
    site = rows["315"]
    assert (site.chromosome, site.end, site.rG4_structural_class, site.rG4_intervals, site.splicing, site.strand) == ("c1", "316", "canonical/G3L1-7", "c1:300-315:+", "False", "+")
    assert (site.refseq_gene_names, site.refseq_transcript_ids, site.refseq_coding_regions) == ("G|gene1;gene-D;gene-J", "NM_1", "CDS;non_coding") and int(site.avg_sequencing_coverage) > 300
    picture = site.sequence_diagram.split("\n")
    assert picture[0] == "            5'- GGGAGGGAGGGAGGG" + "TAGCT" + picture[0][36:] and picture[0].endswith(" -3'")
    assert picture[1:] == ["       rG4seq-K " + "-" * 15 + "*" + "-" * 9, "    rG4seq-KPDS " + "-" * 15 + "*" + "-" * 9]
    # The first base after the junction; its motif-less window is the genome's, whatever was spliced.
    assert rows["600"].rG4_structural_class == "Unknown" and rows["600"].rG4_intervals == "c1:541-601:+" and rows["600"].refseq_coding_regions == "3UTR"
    broken = {x.start: x.sequence_diagram.split("\n") for x in report.read_csv(spark, written[1]).collect()}
    assert [x[:16] for x in broken["315"][1:]] == [f"{n:>16}" for n in ("rG4seq-K-rep1", "rG4seq-K-rep2", "rG4seq-KPDS-rep1", "rG4seq-KPDS-rep2")]
    old = {tuple(x) for x in report.read_csv(spark, written[0]).collect()}
    # The stored stages give the same sites again.
    again = pipeline.Config(config.genome, config.annotations, config.samples, folder=config.folder, omit=("whitelister", "fsr_precompute"))
    assert {tuple(map(str, x)) for x in pipeline.run(spark, again).report().collect()} == old


def test_stages_are_read_again(spark, tmp_path):
    config = pipeline.Config(str(tmp_path / "g.fa"), [("a", str(tmp_path / "a.gff"))], made_up(tmp_path, reps=(1,), kinds=("Li", "K")), folder=str(tmp_path / "out"), name="s")
    written = pipeline.main(spark, config)
    assert [x.rpartition("/")[2] for x in written] == ["s.rG4_list.K-rep1.csv"]
    old = {x.start: x for x in report.read_csv(spark, written[0]).collect()}
    assert {"315", "600"} <= set(old) and old["315"].sequence_diagram.count("\n") == 1
    assert text.bed(spark, config.path("a.whitelist.bed")).count() > 0 and tables.read_motifs(spark, config.path("a.motif.bed")).count() >= 1
    assert tables.read_cutoff(spark, config.path("K-rep1.cutoff.conf")).count() <= 1
    config.omit = ("whitelister", "fsr_precompute")
    new = pipeline.Config(**{**config.__dict__})
    rows = pipeline.signals(spark, new)
    assert rows.where("not decoy and pos in (315, 600)").count() == 2
    tiled, known, white, motifs = pipeline.prepare(spark, new)
    assert white.where("start <= 600 and end > 600").count() == 1 and motifs.where("start = 300 and end = 315").count() >= 1


def test_stops_of_the_control(spark, tmp_path):
    """With treatment and control exchanged, a stop of the treatment is none."""
    config = pipeline.Config(str(tmp_path / "g.fa"), [("a", str(tmp_path / "a.gff"))], made_up(tmp_path), stops_of_control=True)
    assert pipeline.run(spark, config).report().where("start = 315").count() == 0


def test_ini(tmp_path):
    head = "[global]\nWORKING_DIR = {0}/out/\nSAMPLE_NAME = example\nTHREADS = 8\nNO_OF_ANNOTATIONS = 2\nNO_OF_REPLICATES = 2\nHAVE_KPDS_CONDITION = {1}\nALIGNER = {2}\nREADS_TYPE = {3}\n"
    rest = "[genome]\nGENOME_FASTA = g.fa\nGENOME_FASTA_FAI = g.fai\n" + "".join(f"[annotation_{n}]\nANNOTATION_NAME = 'A{n}'\nANNOTATION_GFF = a{n}\n" for n in (1, 2))
    rest += "".join(f"[replicate_{n}]\nLI_BAM_FILE = l{n}\nK_BAM_FILE = k{n}\nKPDS_BAM_FILE = p{n}\n" for n in (1, 2))
    path = tmp_path / "x.ini"
    path.write_text(head.format("/w", "True", "STAR", "PE") + rest + "[debug]\nOMIT = whitelister, fsr_precompute\n")
    c = pipeline.Config.from_ini(str(path))
    assert c.reads == "PE" and c.samples == [("Li", 1, "l1"), ("K", 1, "k1"), ("KPDS", 1, "p1"), ("Li", 2, "l2"), ("K", 2, "k2"), ("KPDS", 2, "p2")] and c.target_fdr == 0.015
    assert c.annotations == [("A1", "a1"), ("A2", "a2")] and c.omit == ("whitelister", "fsr_precompute") and c.path("x") == "/w/out/example.x" and c.conditions == ["K", "KPDS"]
    path.write_text(head.format("/w", "False", "STAR", "SE").replace("THREADS = 8", "TARGET_FDR = 0.1") + rest)
    c = pipeline.Config.from_ini(str(path))
    assert c.target_fdr == 0.1 and c.conditions == ["K"] and len(c.samples) == 4
    for aligner, reads in (("BWA", "SE"), ("STAR", "XX")):
        path.write_text(head.format("/w", "True", aligner, reads) + rest)
        with pytest.raises(ValueError):
            pipeline.Config.from_ini(str(path))


def test_stage_files(spark, tmp_path):
    """Every table between stages is what it was after it was written and read."""
    same = lambda a, b: Counter(map(str, a.collect())) == Counter(map(str, b.select(a.columns).collect()))
    path = lambda n: f"{tmp_path}/{n}"
    blocks = spark.createDataFrame([("K", 1, "c:1", 5, 9, "+", 1), ("K", 1, "c2", 1, 4, "-", 2), ("Li", 2, "c2", 1, 4, ".", 1)], "cond string, rep int, contig string, start int, end int, strand string, ord int")
    tables.write_blocks(blocks, path("blocks"), ("cond", "rep"))
    assert same(blocks, tables.read_blocks(spark, path("blocks")))
    weights = spark.createDataFrame([(1, 2), (7, 0)], "read_id long, weight int")
    tables.write_weights(weights, path("weights"))
    assert same(weights, tables.read_weights(spark, path("weights")))
    piled = spark.createDataFrame([("K", 1, "c", "+", 5, 9, 2), ("K", 1, "c", "-", 4, 1, 0)], "cond string, rep int, contig string, strand string, pos int, cov long, rss long")
    tables.write_pileup(piled, path("pileup"), ("cond", "rep"))
    assert same(piled, tables.read_pileup(spark, path("pileup")))
    rows = spark.createDataFrame([("K", 1, "c", "+", 5, 9, 2, 8, 1, 0.15874, [0.2, 0.05]), ("K", 1, "c", "-", 6, 9, 2, 8, 1, 0.05, None)], "cond string, rep int, contig string, strand string, pos int, cov_t long, rss_t long, cov_c long, rss_c long, first_alpha double, second_alpha array<double>")
    tables.write_signal(rows, path("signal"), ("cond", "rep"))
    assert same(rows, tables.read_signal(spark, path("signal")))
    swapped = tables.read_signal(spark, path("signal"), swapped=True).collect()
    assert {(x.cov_t, x.rss_t, x.cov_c, x.rss_c) for x in swapped} == {(8, 1, 9, 2)}
    lines = spark.createDataFrame([("c\t1\t2\t+\t9\t2\t8\t1",)], "value string")
    assert tables.signal_of(lines).count() == 0
    for bad, read in ((spark.createDataFrame([("c\t1\t2",)], "value string"), tables.signal_of), (spark.createDataFrame([("c\t1\t3\t9\t2\t+",)], "value string"), tables.pileup_of)):
        with pytest.raises(Exception, match="too few fields|not one base"):
            read(bad).collect()
    runs = spark.createDataFrame([("c", 1, 4, "+"), ("c", 9, 12, "-")], "contig string, start int, end int, strand string")
    tables.write_bed(runs, path("bed"))
    assert same(runs, text.bed(spark, path("bed")))
    pieces = "array<struct<start:int,end:int>>"
    motifs = spark.createDataFrame([("c:x", 1, 40, "G|g1", "-", "bulges", "GGA", [(30, 40), (1, 5)], "A|GGA|", [("t1", ["CDS", "3UTR"]), ("t2", [])], [(40, 45)], [], 3)], f"contig string, start int, end int, name string, strand string, class string, sequence string, pieces {pieces}, flank_sequence string, transcripts array<struct<id:string,regions:array<string>>>, left {pieces}, right {pieces}, priority int")
    tables.write_motifs(motifs, path("motifs"))
    assert same(motifs, tables.read_motifs(spark, path("motifs")))
    cut = spark.createDataFrame([(0.1, 0.07)], "first_alpha double, second_alpha double")
    tables.write_cutoff(cut, path("cutoff"))
    assert same(cut, tables.read_cutoff(spark, path("cutoff")))


def test_tables_between_stages_go(spark, tmp_path):
    df = materialize(spark.range(3), "x")
    folder = df.stored_at.removeprefix("file://")
    assert os.path.isdir(folder)
    discard(df)
    assert not os.path.isdir(folder)
    there = lambda x: os.path.isdir(x.stored_at.removeprefix("file://"))
    other = materialize(spark.range(3), "x")
    with pytest.raises(ZeroDivisionError), job(spark):
        outer = materialize(spark.range(3), "x")
        with job(spark):
            inner = materialize(spark.range(3), "x")
        assert there(outer) and not there(inner)
        1 / 0
    assert there(other) and not there(outer)  # what isn't the job's own stays


def test_stream(spark, tmp_path):
    schema = "contig string, strand string, start int, end int, ord int"
    for k in range(2):
        spark.createDataFrame([("c", "+", 0, 3, 1), ("c", "-", 1, 4, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = running_pileup(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("piled").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(x.strand, x.pos, x.cov, x.rss) for x in spark.table("piled").collect()} == {("+", 0, 2, 2), ("+", 1, 2, 0), ("+", 2, 2, 0), ("-", 1, 2, 0), ("-", 2, 2, 0), ("-", 3, 2, 2)}
