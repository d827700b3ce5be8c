"""WARC files as a PySpark data source, and revisit records for equal payloads.

Writing: every task writes gzip members, a record each, to files of its own under a temporary name and renames
them when it is done; the driver's commit lists the files of the tasks that counted, so that a lost or repeated
task leaves nothing that a reader sees. Each member says in its gzip header how long it is ("sl", compressed and
uncompressed), so that a reader passes over it without decoding.

Reading: files are dealt to partitions by size. A record's header block is decoded first; comparisons of
record_type, record_id, target_uri and payload_digest with values are pushed down and tested on it, and the
payload is decoded only for records that pass, and only if it is asked for. Files of others, without "sl", and
uncompressed ones are read too.

Options: path; date (of the records written); payload (true or false: whether to decode payloads).
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from stallmap.llm.common import shared_dir, small
from stallmap.storage import qualified

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
FILE_BYTES = 64 << 20
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
LEVEL = 3
HEAD = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANY_PAYLOADS = 500_000


def digest32(payload: bytes) -> str:
    """SHA-1 in base32, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, kind: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record. A revisit has the payload's digest and length, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date}
    if uri:
        head["WARC-Target-URI"] = uri.replace("\r", "%0D").replace("\n", "%0A")
    head["WARC-Payload-Digest"] = f"sha1:{digest32(payload)}"
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that says its own length in its header."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    total = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        part, files, out, size, name = TaskContext.get().partitionId(), [], None, 0, ""

        def close() -> None:
            out.close()
            fs.move(f"{root}/.{name}.tmp", f"{root}/{name}")
            files.append((name, size))

        for batch in iterator:
            cols = {n: batch.column(n).to_pylist() for n in ("record_id", "record_type", "target_uri", "refers_to")}
            payloads = batch.column("payload").cast(pa.large_binary()).to_pylist()
            for i, payload in enumerate(payloads):
                data = member(record(cols["record_id"][i], cols["record_type"][i], cols["target_uri"][i], payload or b"", cols["refers_to"][i], self.date))
                if out is None:
                    name, size = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/.{name}.tmp")
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


@dataclass
class Files(InputPartition):
    names: list


def parse_head(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}


class _Records:
    """The records of a file, header first. payload() decodes what is left of the current one."""

    def __init__(self, f: io.BufferedReader, zipped: bool):
        self.f, self.zipped = f, zipped

    def _member(self) -> bool:
        """Begins the next gzip member; sets its end if the header tells it."""
        start, head = self.f.tell(), self.f.read(10)
        if len(head) < 10:
            return False
        self.end, flags = None, head[3]
        if flags & 4:
            extra = self.f.read(struct.unpack("<H", self.f.read(2))[0])
            while len(extra) >= 4:
                key, n = extra[:2], struct.unpack("<H", extra[2:4])[0]
                if key == b"sl" and n == 8:
                    self.end = start + struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        for bit in (8, 16):  # name and comment
            while flags & bit and self.f.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            self.f.read(2)
        self.unpack, self.left = zlib.decompressobj(-15), b""
        return True

    def _more(self, n: int) -> bytes:
        """About n more bytes of the record, fewer at its end."""
        if not self.zipped:
            return self.f.read(n)
        got = b""
        while not got and not self.unpack.eof:
            if not self.left:
                want = 1 << 13 if self.end is None else max(1, min(1 << 20, self.end - self.f.tell()))
                self.left = self.f.read(want)
                if not self.left:
                    break
            got = self.unpack.decompress(self.left, n)
            self.left = self.unpack.unconsumed_tail
        return got

    def heads(self) -> Iterator[dict[str, str]]:
        while True:
            if self.zipped and not self._member():
                return
            have = b""
            while b"\r\n\r\n" not in have.lstrip():
                more = self._more(HEAD if self.zipped else 1 << 10)
                if not more:
                    break
                have += more
            have = have.lstrip()
            if not have:
                return
            head, _, self.have = have.partition(b"\r\n\r\n")
            fields = parse_head(head)
            self.length = int(fields.get("Content-Length", 0))
            yield fields
            if self.zipped:
                self._skip()
            else:
                self.f.seek(self.f.tell() + self.length - len(self.have))

    def _skip(self) -> None:
        if self.end is not None:
            self.f.seek(self.end)
            return
        while self._more(1 << 20):
            pass
        self.f.seek(self.f.tell() - len(self.unpack.unused_data) + 8)

    def block(self) -> bytes:
        parts, n = [self.have], len(self.have)
        while n < self.length:
            more = self._more(min(1 << 20, self.length - n) if not self.zipped else 1 << 20)
            if not more:
                raise ValueError("a record ends before its length")
            parts.append(more)
            n += len(more)
        data = b"".join(parts)
        if not self.zipped:
            self.have = data
        return data[: self.length]


class WarcReader(DataSourceReader):
    FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest"}

    def __init__(self, options: dict):
        self.path, self.want = options["path"].rstrip("/"), options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the tests that a record's header answers; the others are Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 else None
            if column not in self.FIELDS:
                yield f
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            else:
                self.tests.append((column, "=" if isinstance(f, EqualTo) else "^", f.value))

    def partitions(self) -> list[Files]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        there = fs.get_file_info(pafs.FileSelector(root))
        names = [x.base_name for x in there if x.base_name.startswith("_files-")]
        if names:
            files = sorted(tuple(x) for n in names for x in json.loads(fs.open_input_stream(f"{root}/{n}").read()))
        else:
            files = sorted((x.base_name, x.size) for x in there if x.base_name.endswith((".warc", ".warc.gz")))
        parts, size = [[]], 0
        for name, n in files:
            if parts[-1] and size + n > SPLIT_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(name)
            size += n
        return [Files(p) for p in parts]

    def _passes(self, row: dict) -> bool:
        for column, how, value in self.tests:
            x = row[column]
            if x is None or not (x in value if how == "in" else x == value if how == "=" else x.startswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for name in partition.names:
            with fs.open_input_file(f"{root}/{name}") as raw:
                records = _Records(io.BufferedReader(raw, 1 << 16), name.endswith(".gz"))
                for head in records.heads():
                    bare = lambda k: head[k].strip("<>") if k in head else None
                    row = {"record_id": bare("WARC-Record-ID"), "record_type": head.get("WARC-Type"), "target_uri": head.get("WARC-Target-URI")}
                    row["payload_digest"] = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    if not self._passes(row):
                        continue
                    payload, length = None, None
                    if head.get("Content-Type", "").startswith("application/http"):
                        if self.want or len(records.have) >= records.length:
                            http, _, payload = records.block().partition(b"\r\n\r\n")
                        else:
                            http = records.have.partition(b"\r\n\r\n")[0]
                        length = int(parse_head(http).get("Content-Length", 0))
                    elif self.want:
                        payload = records.block()
                        length = len(payload)
                    if not self.want or row["record_type"] == "revisit":
                        payload = None
                    rows.append((*row.values(), length, bare("WARC-Refers-To"), list(head.items()), payload))
                    size += len(payload or b"") + 500
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("write to a new folder, or append")
        return WarcWriter(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row of pages to path.

    Of rows with equal payloads of at least least_bytes, those with the largest id are responses and the others
    revisit it; all smaller ones are responses. Null html: an empty payload. Null ids are told from others by
    no one: they revisit an equal payload that has an id, else they are responses. An empty table writes no
    record. Other columns of pages are not looked at.
    """
    register(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), body.alias("payload"))
    rows = rows.withColumn("sum", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    # Of all digests only those that come twice or more go on: a few, or a shuffle that splits its hot keys.
    firsts = rows.where("sum is not null").groupBy("sum").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select(F.col("sum").alias("its"), "first").persist()
    named = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    out = rows.join(small(firsts, MANY_PAYLOADS), F.col("sum") == F.col("its"), "left").select(
        named("id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, named("first")).alias("refers_to"),
        "payload",
    )
    out.write.format("warc").mode("append").option("path", path).save()
    firsts.unpersist()


def page_records(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Writes pages as archives and reads them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Responses are measured on the payload that was read; of revisits only headers are read.
    Nulls, ties, repeated rows and empty tables are as in archive(); a very long payload is one record, which a task holds."""
    spark = pages.sparkSession
    # Archives are written by another library than Spark's, which must find the same folder.
    path = qualified(spark, folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    archive(pages, path, **how)
    read = lambda payload: spark.read.format("warc").option("path", path).option("payload", payload).load()
    page = lambda c: F.regexp_extract(F.col(c), r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    responses = read("true").where("record_type = 'response'").withColumn("payload_length", F.octet_length("payload").cast("long"))
    revisits = read("false").where("record_type = 'revisit'")
    cols = [number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to")]
    return responses.select(*cols).unionByName(revisits.select(*cols))
