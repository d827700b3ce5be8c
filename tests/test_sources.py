"""Sources that are read in parts of a file: BAM by blocks, FASTA by its index."""

import random
import struct
import zlib
from collections import Counter

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from stallmap.functions import genome
from stallmap.sources import bam, fasta, text

EMPTY = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(part: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(part) + pack.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


def record(r: random.Random, i: int, n: int) -> bytes:
    """With an odd name, bases and tags, among them some that look like blocks and like records."""
    name = f"read/{i}:{r.randint(0, 9)}".encode() + b"\0"
    mapped = r.random() < 0.9
    ops = [(r.randint(1, 500), r.randint(0, 8)) for _ in range(r.randint(0, 5))] if mapped else []
    body = struct.pack("<iiBBHHHiiii", r.randint(0, 2) if mapped else -1, r.randint(0, 10_000) if mapped else -1, len(name), 255, 0, len(ops), 16 * (i % 2), n, -1, -1, 0)
    body += name + b"".join(struct.pack("<I", k << 4 | op) for k, op in ops) + r.randbytes((n + 1) // 2) + b"\xff" * n
    body += b"NHC" + bytes([i % 5]) + b"XBBs" + struct.pack("<ihh", 2, 1, 2) + b"XZZ" + r.choice([b"x", b"\x1f\x8b\x08\x04" * 3, b"\1\1\1"]) + b"\0MDZ50\0"
    return struct.pack("<i", len(body)) + body


def bam_bytes(seed: int, sizes: list[int], contents: tuple[int, int], contigs: int = 3) -> bytes:
    """A file whose blocks hold so many bytes each, cut without regard to records."""
    r = random.Random(seed)
    head = b"@HD\tVN:1.6\tSO:coordinate\n" + b"@CO\tx\n" * r.choice([0, 3000])
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", contigs)
    for k in range(contigs):
        data += struct.pack("<i", 3) + f"c{k}".encode() + b"\0" + struct.pack("<i", 20_000)
    data += b"".join(record(r, i, n) for i, n in enumerate(sizes))
    out, at = b"", 0
    while at < len(data):
        n = r.randint(*contents)
        out += block(data[at : at + n], r.choice([0, 6]))
        if r.random() < 0.1:
            out += EMPTY  # blocks without contents may stand anywhere
        at += n
    return out + EMPTY


def rows_of(path: str, cuts: list[int]) -> list[list[tuple]]:
    reader = bam.BamReader({"path": path})
    whole = reader.partitions()[0]
    found = []
    for a, b in zip(cuts, cuts[1:]):
        own = bam.Range(whole.path, a, b, whole.size)
        found.append([tuple(x.values()) for batch in reader.read(own) for x in batch.to_pylist()])
    return found


@pytest.mark.parametrize("seed", range(12))
def test_bam_ranges_give_each_record_once(tmp_path, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 50, 100, 4000]) for _ in range(r.choice([0, 1, 40, 400]))]
    if seed % 3 == 0:
        sizes[3:3] = [90_000, 200_000]  # records over several blocks
    (tmp_path / "a.bam").write_bytes(bam_bytes(seed, sizes, (1, 300) if seed % 2 else (3000, 60_000)))
    size, path = (tmp_path / "a.bam").stat().st_size, f"file://{tmp_path}/a.bam"
    whole = rows_of(path, [0, size])[0]
    assert len(whole) == len(sizes) and len({x[0].split(":")[0] for x in whole}) == len(sizes)
    for n in (1, 4, 9):
        cuts = sorted({0, size, *(r.randrange(size + 1) for _ in range(n))})
        parts = rows_of(path, cuts)
        assert [x for part in parts for x in part] == whole


def test_bam_file_in_partitions(spark, tmp_path):
    sizes = [100] * 6000
    (tmp_path / "a.bam").write_bytes(bam_bytes(5, sizes, (20_000, 60_000)))
    size = (tmp_path / "a.bam").stat().st_size
    spark.dataSource.register(bam.Bam)
    df = spark.read.format("bam").option("path", f"file://{tmp_path}/a.bam").option("partBytes", -(-size // 5)).load()
    assert df.rdd.getNumPartitions() == 5
    by = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct("qname").alias("d")).collect()
    assert len(by) == 5 and sum(x.n for x in by) == sum(x.d for x in by) == 6000 and max(x.n for x in by) < 2000


def test_damaged_bam_is_an_error(tmp_path):
    data = bytearray(bam_bytes(1, [100] * 300, (9000, 9000)))
    data[len(data) // 2] ^= 1
    (tmp_path / "a.bam").write_bytes(data)
    with pytest.raises(Exception):  # noqa: B017
        rows_of(f"file://{tmp_path}/a.bam", [0, len(data)])


# ---- FASTA ----


def sequences(r: random.Random, n: int, most: int) -> list[tuple[str, str, str]]:
    """name, rest of the header, bases (soft-masked)."""
    heads = ["", " a->b", " x > y", "\t>z", " long " + "h" * 300]
    return [(f"c{i}", r.choice(heads), "".join(r.choice("ACGTacgtNn") for _ in range(r.choice([0, 1, 9, 10, 11, r.randint(1, most)])))) for i in range(n)]


def fasta_text(found: list, width: int, end: str, final: bool = True) -> str:
    lines = []
    for name, rest, seq in found:
        lines += [f">{name}{rest}", *(seq[k : k + width] for k in range(0, len(seq), width))]
    return end.join(lines) + (end if final else "")


def faidx(data: bytes) -> list[tuple]:
    """The index by a walk over lines."""
    out, at = [], 0
    for line in data.splitlines(keepends=True):
        at += len(line)
        own = line.rstrip(b"\r\n")
        if own.startswith(b">"):
            out.append([own[1:].split()[0].decode(), 0, at, 0, 0])
        elif own:
            if not out[-1][3]:
                out[-1][3:] = [len(own), len(own) + (len(line) - len(own) or 1)]
            out[-1][1] += len(own)
    return [tuple(x) for x in out]


@pytest.mark.parametrize("end, final", [("\n", True), ("\r\n", True), ("\n", False)])
@pytest.mark.parametrize("width", [10, 61])
def test_fasta_index_and_tiles(spark, tmp_path, monkeypatch, end, final, width):
    monkeypatch.setattr(fasta, "READ", 64)
    monkeypatch.setattr(genome, "WIDTH", 50)
    monkeypatch.setattr(genome, "REACH", 12)
    r = random.Random(width)
    found = sequences(r, 25, 700)
    data = fasta_text(found, width, end, final).encode()
    path = tmp_path / "g.fa"
    path.write_bytes(data)
    want = {(n, s) for n, _, s in found}
    assert {(x.contig, x.seq) for x in text.fasta(spark, str(path)).collect()} == want
    for part in (37, 300, 10_000):
        got = fasta.index(spark, str(path), part).orderBy("offset").collect()
        assert all(x.even for x in got)
        own = [(x.contig, x.length, x.offset, x.line_bases, x.line_bytes) for x in got]
        if final:
            assert own == faidx(data)
        assert [x[:3] for x in own] == [x[:3] for x in faidx(data)]
    plain = Counter(tuple(x) for x in genome.tiles(text.fasta(spark, str(path))).collect())
    options = {"width": 50, "reach": 12}

    def tiled(**more) -> Counter:
        df = spark.read.format("fasta_tiles").option("path", f"file://{path}")
        for k, v in (options | more).items():
            df = df.option(k, v)
        return Counter(tuple(x) for x in df.load().collect())

    spark.dataSource.register(fasta.Fasta)
    (tmp_path / "g.fa.fai").write_text("".join("\t".join(map(str, x)) + "\n" for x in faidx(data)))
    for part in (1, 120, 100_000):
        assert tiled(partBytes=part) == plain
    (tmp_path / "g.fa.fai").rename(tmp_path / "other.fai")
    assert tiled(index=f"file://{tmp_path}/other.fai") == plain


def test_tiles_of_a_file(spark, tmp_path):
    r = random.Random(3)
    found = [("one", " a>b", "".join(r.choice("ACGTn") for _ in range(50_000))), ("two", "", "ACGT" * 5), ("none", "", "")]
    path = tmp_path / "g.fa"
    path.write_text(fasta_text(found, 60, "\n"))
    plain = Counter(tuple(x) for x in genome.tiles(text.fasta(spark, str(path))).collect())
    assert Counter(tuple(x) for x in fasta.tiles(spark, str(path), 9000).collect()) == plain
    # One line for a contig, however long.
    path.write_text(fasta_text(found, 100_000, "\n"))
    assert Counter(tuple(x) for x in fasta.tiles(spark, str(path), 9000).collect()) == plain
    # Ragged lines have no index; they are still read.
    path.write_text(">one a>b\nAC\nACGTACGT\nA\n>two\nACGT\n")
    assert not all(x.even for x in fasta.index(spark, str(path), 5).collect())
    assert {(x.contig, x.part) for x in fasta.tiles(spark, str(path)).collect()} == {("one", "ACACGTACGTA"), ("two", "ACGT")}
    path.write_text("")
    assert fasta.tiles(spark, str(path)).count() == 0
    # An index of another file is noticed.
    path.write_text(">one\nACGT\n")
    (tmp_path / "g.fa.fai").write_text("one\t40\t5\t10\t11\n")
    with pytest.raises(Exception, match="doesn't fit"):
        fasta.tiles(spark, str(path)).collect()


def test_a_contig_is_many_partitions(spark, tmp_path):
    path = tmp_path / "g.fa"
    path.write_text(fasta_text([("one", "", "ACGT" * 50_000)], 60, "\n"))
    df = fasta.tiles(spark, str(path), 40_000)
    assert df.rdd.getNumPartitions() >= 5 and df.agg(F.max(F.length("part"))).first()[0] <= genome.WIDTH + genome.REACH
    assert isinstance(pafs.FileSystem.from_uri(f"file://{path}")[0], pafs.LocalFileSystem)
