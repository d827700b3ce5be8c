"""A PySpark data source for BAM: qname, flag, mapq, nh, contig, pos, cigar, md.

spark.dataSource.register(Bam); spark.read.format("bam").option("path", ...), of a file or a folder. Files are cut into ranges of
about partBytes bytes, each a partition, without an index. A range has the records that begin in one of its compressed blocks: its
task looks for the first block (by the magic bytes, the place of the next block, and its checksum), then for the first record in it (the first
place from which on a chain of records holds), and reads on beyond the range to the end of its last record. A task streams: it
holds a few blocks and one batch of rows. Files must say in their header that they are sorted by coordinate, unless the option sorted is false.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, mapq int, nh int, contig string, pos int, cigar string, md string"
_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_FORMATS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
ROWS = 20_000


PART_BYTES = 64 << 20
_MAGIC = b"\x1f\x8b\x08\x04"
#: A block's header and footer, and the most bytes that a block has.
_HEAD, _FOOT, _MOST = 18, 8, 1 << 16
#: Records in a row that must hold for a place to be the start of one, and the most bytes a record is believed to have.
CHAIN, LONGEST = 6, 1 << 27


@dataclass
class Range(InputPartition):
    """The records that begin in blocks that begin in [start, end) of a file of so many bytes."""

    path: str
    start: int
    end: int
    size: int


def _block_size(head: bytes) -> int | None:
    """The length of the compressed block with this header, if it is one."""
    if len(head) < _HEAD or head[:4] != _MAGIC or head[12:16] != b"BC\2\0":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def _block_at(f, at: int) -> tuple[bytes, int] | None:
    """The contents of the block at a place, and the place of the next; None at the end of the file."""
    f.seek(at)
    head = f.read(_HEAD)
    if not head:
        return None
    size = _block_size(head)
    rest = f.read(size - _HEAD) if size else b""
    if not size or len(rest) < size - _HEAD:
        raise ValueError(f"no whole block at byte {at}")
    data = zlib.decompress(rest[:-_FOOT], -15)
    if struct.unpack("<II", rest[-_FOOT:]) != (zlib.crc32(data), len(data)):
        raise ValueError(f"the block at byte {at} is damaged")
    return data, at + size


def first_block(f, start: int, end: int, size: int) -> int | None:
    """The place of the first block that begins in [start, end)."""
    while start < end:
        f.seek(start)
        near = f.read(min(_MOST + _HEAD, size - start))
        at = near.find(_MAGIC)
        while 0 <= at < min(end - start, _MOST):
            own = start + at
            length = _block_size(near[at : at + _HEAD])
            if length:
                f.seek(own + length)
                after = f.read(_HEAD)
                if own + length == size or _block_size(after):
                    try:
                        _block_at(f, own)
                        return own
                    except (ValueError, zlib.error):
                        pass  # bytes that only look like a block
            at = near.find(_MAGIC, at + 1)
        start += _MOST
    return None


class _Blocks:
    """The contents of a file from a block on, and in which block each byte lies."""

    def __init__(self, f, at: int):
        self.f, self.next, self.have, self.at, self.before = f, at, b"", 0, 0
        self.begins: deque[tuple[int, int]] = deque()  # of blocks: the first byte of their contents, and their place

    def _next(self) -> bool:
        found = _block_at(self.f, self.next)
        if found is None:
            return False
        self.begins.append((self.before + len(self.have), self.next))
        self.before, self.have, self.at = self.before + self.at, self.have[self.at :] + found[0], 0
        self.next = found[1]
        return True

    def more(self, n: int = 1) -> bool:
        """Whether there are n bytes more."""
        while len(self.have) - self.at < n:
            if not self._next():
                return False
        return True

    def block(self) -> int:
        """The place of the block that the next byte lies in; there must be one."""
        while len(self.begins) > 1 and self.begins[1][0] <= self.before + self.at:
            self.begins.popleft()
        return self.begins[0][1]

    def read(self, n: int) -> bytes:
        if not self.more(n):
            return b""
        self.at += n
        return self.have[self.at - n : self.at]

    def number(self) -> int | None:
        raw = self.read(4)
        return struct.unpack("<i", raw)[0] if raw else None


def _is_record(data: _Blocks, at: int, lengths: list[int]) -> int | None:
    """Where the record that begins so far ahead ends, if it can be one."""
    if not data.more(at + 36):
        return None
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data.have, data.at + at)
    least = 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq
    if not (0 <= n_seq and least <= size <= LONGEST and n_name):
        return None
    for r, p in ((ref, pos), (next_ref, next_pos)):
        if not -1 <= r < len(lengths) or not -1 <= p or r >= 0 and p > lengths[r]:
            return None
    if not data.more(at + 4 + size):
        return None
    own = data.have[data.at + at + 4 : data.at + at + 4 + size]
    name = own[32 : 32 + n_name]
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return None
    if any(x & 15 > 8 for x in struct.unpack_from(f"<{n_ops}I", own, 32 + n_name)):
        return None
    try:
        _tags(own[least:], True)
    except (ValueError, KeyError, IndexError, struct.error):
        return None
    return at + 4 + size


def to_first_record(data: _Blocks, end: int, lengths: list[int]) -> bool:
    """Moves on to the first place where a record begins in a block before `end`, if there is one."""
    while data.more() and data.block() < end:
        at, n = 0, 0
        while n < CHAIN and at is not None and data.more(at + 1):
            at, n = _is_record(data, at, lengths), n + 1
        if at is not None:
            return True
        data.at += 1
    return False


def _tags(data: bytes, strict: bool = False) -> tuple[int | None, str | None]:
    """NH and MD. Strict: an error unless the tags are sound and fill the data."""
    nh, md, at = None, None, 0
    while at + 3 <= len(data):
        if strict and not data[at : at + 2].isalnum():
            raise ValueError("no tag")
        key, kind, at = data[at : at + 2], chr(data[at + 2]), at + 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            if key == b"MD":
                md = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + _TAG_SIZES[chr(data[at])] * struct.unpack("<i", data[at + 1 : at + 5])[0]
        else:
            if key == b"NH" and kind in _TAG_FORMATS:
                nh = struct.unpack(_TAG_FORMATS[kind], data[at : at + _TAG_SIZES[kind]])[0]
            at += _TAG_SIZES[kind]
    if strict and at != len(data):
        raise ValueError("tags don't fill the record")
    return nh, md


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sorted = options["path"], options.get("sorted", "true").lower() == "true"
        self.part = int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Range]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith(".bam")]
        cut = [Range(x.path, at, min(at + self.part, x.size), x.size) for x in files for at in range(0, max(1, x.size), self.part)]
        return cut or [Range("", 0, 0, 0)]

    def _head(self, f, path: str) -> tuple[list[str], list[int], _Blocks]:
        """Names and lengths of contigs, and the file right behind the header."""
        data = _Blocks(f, 0)
        if data.read(4) != b"BAM\1":
            raise ValueError(f"{path} isn't a BAM file")
        text = data.read(data.number()).decode()
        if self.sorted and not re.search(r"^@HD\t.*SO:coordinate", text, re.M):
            raise ValueError(f"{path} isn't sorted by coordinate")
        names, lengths = [], []
        for _ in range(data.number()):
            names.append(data.read(data.number())[:-1].decode())
            lengths.append(data.number())
        return names, lengths, data

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as raw:
            names, lengths, data = self._head(raw, partition.path)
            if not data.more():
                return
            if data.block() < partition.start:  # else the range begins with the header, and the first record is known
                at = first_block(raw, partition.start, partition.end, partition.size)
                data = None if at is None else _Blocks(raw, at)
                if data is None or not to_first_record(data, partition.end, lengths):
                    return
            rows: list[tuple] = []
            while data.more() and data.block() < partition.end:
                r = data.read(data.number())
                ref, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack("<iiBBHHHi", r[:20])
                ops_at = 32 + n_name
                ops = struct.unpack(f"<{n_ops}I", r[ops_at : ops_at + 4 * n_ops])
                tags_at = ops_at + 4 * n_ops + (n_seq + 1) // 2 + n_seq
                nh, md = _tags(r[tags_at:])
                cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in ops) or "*"
                rows.append((r[32 : ops_at - 1].decode(), flag, mapq, nh, names[ref] if ref >= 0 else "*", pos, cigar, md))
                if len(rows) >= ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=names)


class Bam(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))
