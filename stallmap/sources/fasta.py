"""A PySpark data source for FASTA files by their index: tiles of bases, none of which needs more than its own bytes.

spark.dataSource.register(Fasta); spark.read.format("fasta_tiles").option("path", ...). The index is the usual one of five columns (name,
bases, place of the first base, bases of a line, bytes of a line), from the file with .fai at the end or from the option index, a file
or a folder of files. A partition has tiles of about partBytes bytes: of a part of a long contig, or of many short ones. index() makes the
index where there is none, in one Spark pass over byte ranges.

Lines of a contig must be of one length but for its last; ragged(), or the lack of such an index, sends a file to sources.text.fasta, which
holds a contig in a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stallmap.functions import genome
from stallmap.sources import text
from stallmap.storage import materialize, qualified

PART_BYTES = 32 << 20
READ = 1 << 20
INDEX = "contig string, length long, offset long, line_bases long, line_bytes long"
_NEWLINE, _RETURN, _HEADER = 10, 13, 62


@dataclass
class Tiles(InputPartition):
    """stretches: (contig, its first and last tile here, length, offset, line_bases, line_bytes)."""

    path: str
    stretches: list[tuple] = field(default_factory=list)


def _files(fs: pafs.FileSystem, path: str) -> list[str]:
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", ".")))


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.index = options["path"], options.get("index", options["path"] + ".fai")
        self.part, self.width, self.reach = int(options.get("partbytes", PART_BYTES)), int(options.get("width", genome.WIDTH)), int(options.get("reach", genome.REACH))

    def partitions(self) -> list[Tiles]:
        fs, root = pafs.FileSystem.from_uri(self.index)
        _, path = pafs.FileSystem.from_uri(self.path)
        each = max(1, self.part // self.width)
        out, room = [], 0
        for name in _files(fs, root):
            for line in fs.open_input_stream(name, compression=None).readall().decode().splitlines():
                contig, *numbers = line.split("\t")
                length, offset, bases, size = map(int, numbers[:4])
                tiles, at = -(-length // self.width), 0
                while at < tiles:
                    if not room:
                        out.append(Tiles(path))
                        room = each
                    n = min(room, tiles - at)
                    out[-1].stretches.append((contig, at, at + n - 1, length, offset, bases, size))
                    at, room = at + n, room - n
        return out or [Tiles("")]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as f:
            for contig, first, last, length, offset, bases, size in partition.stretches:
                place = lambda b: offset + b // bases * size + b % bases  # noqa: B023, E731
                step = max(1, READ // self.width)
                for low in range(first, last + 1, step):
                    high = min(low + step, last + 1)
                    start, end = low * self.width, min(high * self.width + self.reach, length)
                    f.seek(place(start))
                    seq = f.read(place(end - 1) + 1 - place(start)).translate(None, b"\r\n").decode("latin-1")
                    if len(seq) != end - start:
                        raise ValueError(f"the index of {self.path} doesn't fit it at {contig}")
                    cut = [seq[k : k + self.width + self.reach] for k in range(0, (high - low) * self.width, self.width)]
                    yield pa.RecordBatch.from_arrays([pa.array([contig] * len(cut)), pa.array(range(low, high), pa.int32()), pa.array(cut)], names=["contig", "tile", "part"])


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_tiles"

    def schema(self) -> str:
        return "contig string, tile int, part string"

    def reader(self, schema) -> TileReader:
        return TileReader(dict(self.options))


# ---- the index ----

#: What the lines that begin in a range of bytes say: a row for each stretch of them, which a header begins (name) or which goes on with the
#: contig of an earlier range (name is null). width: bases and bytes of its first line; even: whether all others but the last have these; last: those of its last line.
_STRETCH = "at long, name string, offset long, length long, first_bases long, first_bytes long, even boolean, last_bases long, last_bytes long, lines long"


@dataclass
class Bytes(InputPartition):
    path: str
    start: int
    end: int


class LineReader(DataSourceReader):
    """The stretches of lines that begin in each range of bytes."""

    def __init__(self, options: dict):
        self.path, self.part = options["path"], int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Bytes]:
        fs, path = pafs.FileSystem.from_uri(self.path)
        size = fs.get_file_info(path).size
        return [Bytes(path, at, min(at + self.part, size)) for at in range(0, size or 0, self.part)] or [Bytes("", 0, 0)]

    def _lines(self, f, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, str]]]:
        """Of the lines that begin in [start, end), those that end in each READ bytes: where they begin, their bytes, their bases, and
        the names of those that are headers. No line is held, but for headers."""
        pos = max(0, start - 1)
        f.seek(pos)
        while start:  # to the first line that begins here
            data = f.read(READ)
            k = data.find(b"\n")
            pos += k + 1 if k >= 0 else len(data)
            if k >= 0 or not data:
                break
        f.seek(pos)
        at, before, title = pos, 0, None  # where the line at hand begins; the byte before; the header so far, if it is one
        while at < end:
            data = f.read(READ)
            last = not data
            if last:
                if pos == at:
                    return
                data = b"\n"  # the last line needs none
            raw = np.frombuffer(data, np.uint8)
            ends = np.flatnonzero(raw == _NEWLINE)
            if pos == at and raw[0] == _HEADER:
                title = b""
            if len(ends):
                begins = np.concatenate([[at], pos + ends[:-1] + 1])
                size = pos + ends + 1 - begins
                returned = np.where(ends > 0, raw[np.maximum(ends - 1, 0)], before) == _RETURN
                heads = raw[ends[:-1] + 1] == _HEADER
                names = {} if title is None else {0: title + data[: ends[0]]}
                names |= {int(k) + 1: data[ends[k] + 1 : ends[k + 1]] for k in np.flatnonzero(heads)}
                words = {k: v[1:].split() for k, v in names.items()}
                keep = begins < end
                named = {k: v[0].decode() if v else "" for k, v in words.items() if keep[k]}
                yield begins[keep], size[keep], (size - 1 - (returned & (size > 1)))[keep], named
                rest = int(ends[-1]) + 1
                at = pos + rest
                title = data[rest:] if rest < len(data) and raw[rest] == _HEADER else None
            elif title is not None:
                title += data
            before, pos = raw[-1], pos + len(data)
            if last:
                return

    def read(self, partition: Bytes) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        now: dict | None = None
        fields = [x.split()[0] for x in _STRETCH.split(", ")]
        fresh = lambda at, name, offset: dict.fromkeys(fields, 0) | {"at": at, "name": name, "offset": offset, "even": True}
        with fs.open_input_file(partition.path) as f:
            for begins, size, bases, names in self._lines(f, partition.start, partition.end):
                heads = sorted(names)
                for k, j in zip([-1, *heads], [*heads, len(begins)]):
                    if k >= 0:
                        if now:
                            yield tuple(now[x] for x in fields)
                        now = fresh(int(begins[k]), names[k], int(begins[k] + size[k]))
                    if k + 1 == j:
                        continue
                    b, n = bases[k + 1 : j], size[k + 1 : j]
                    now = now or fresh(int(begins[k + 1]), None, int(begins[k + 1]))
                    if not now["lines"]:
                        now |= {"first_bases": int(b[0]), "first_bytes": int(n[0])}
                    else:
                        now["even"] &= (now["last_bases"], now["last_bytes"]) == (now["first_bases"], now["first_bytes"])
                    now["even"] &= bool((b[:-1] == now["first_bases"]).all() and (n[:-1] == now["first_bytes"]).all())
                    now |= {"last_bases": int(b[-1]), "last_bytes": int(n[-1]), "length": now["length"] + int(b.sum()), "lines": now["lines"] + len(b)}
        if now:
            yield tuple(now[x] for x in fields)


class FastaLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_lines"

    def schema(self) -> str:
        return _STRETCH

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))


def index(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """contig, length, offset, line_bases, line_bytes, even: of each contig of an unzipped file, in one pass over its ranges of bytes.
    even is false if its lines, but for the last, aren't of one length: then the index can't say where a base stands."""
    spark.dataSource.register(FastaLines)
    rows = spark.read.format("fasta_lines").option("path", qualified(spark, path)).option("partBytes", part_bytes).load()
    # A row for each contig and range: as small as the index itself.
    order = Window.orderBy("at")
    named = rows.withColumn("nth", F.count("name").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("nth > 0 and (lines > 0 or name is not null)")
    own = Window.partitionBy("nth").orderBy("at")
    width = lambda c: F.first(F.when(F.col("lines") > 0, F.col(c)), True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wide = named.withColumns({"b": width("first_bases"), "n": width("first_bytes"), "final": F.lead("at").over(own).isNull()})
    # All lines are like the contig's first; the last line of all may be shorter.
    like = F.col("even") & ((F.col("lines") == 1) | (F.col("first_bases") == F.col("b")) & (F.col("first_bytes") == F.col("n")))
    ends = F.when(F.col("final"), F.col("last_bases") <= F.col("b")).otherwise((F.col("last_bases") == F.col("b")) & (F.col("last_bytes") == F.col("n")))
    fine = (F.col("lines") == 0) | like & ends
    return wide.groupBy("nth").agg(
        F.first("name", True).alias("contig"), F.sum("length").alias("length"), F.min("offset").alias("offset"), F.coalesce(F.max("b"), F.lit(0)).alias("line_bases"),
        F.coalesce(F.max("n"), F.lit(0)).alias("line_bytes"), F.min(fine).alias("even"),
    ).drop("nth")


def tiles(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """contig, tile, part, as genome.tiles() gives them: by the index beside the file, else by one that is made and stored
    where all executors see it. Files that are zipped, or whose lines are ragged, are read contig by contig."""
    full = qualified(spark, path)
    fs, root = pafs.FileSystem.from_uri(full)
    spark.dataSource.register(Fasta)
    read = spark.read.format("fasta_tiles").option("path", full).option("partBytes", part_bytes)
    if fs.get_file_info(root + ".fai").type == pafs.FileType.File:
        return read.load()
    if fs.get_file_info(root).type != pafs.FileType.File or root.endswith((".gz", ".bgz", ".bz2")):
        return genome.tiles(text.fasta(spark, path))
    made = materialize(index(spark, path, part_bytes), "fasta-index")
    if not made.where("not even").isEmpty():
        return genome.tiles(text.fasta(spark, path))
    line = F.concat_ws("\t", "contig", "length", "offset", "line_bases", "line_bytes")
    where = f"{made.stored_at}.fai"
    made.where("length > 0").select(line.alias("value")).write.text(where)
    return read.option("index", qualified(spark, where)).load()
