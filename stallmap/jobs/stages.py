"""Stored stages of a job that are used again as long as they hold.

A stage is a folder of files. When all are written, a manifest is put beside them, last: a fingerprint of the settings and of the inputs
(name, bytes and time of each file), and the stage's own files with their bytes. A stage holds if its manifest is there, has
the same fingerprint, and the files are those it names. So a folder that was left half-written is never read, and a changed
input makes just those stages anew that depend on it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

MANIFEST = "_stage.json"


def _of(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Of a file, or of a folder and all below it: name, bytes and time of change of each file, in order. Nothing if it isn't there."""
    fs, top = _of(spark, path)
    if not fs.exists(top):
        return []
    root, out = fs.makeQualified(top).toString().rstrip("/"), []
    found = fs.listFiles(top, True)
    while found.hasNext():
        x = found.next()
        out.append((x.getPath().toString().removeprefix(root), x.getLen(), x.getModificationTime()))
    return sorted(out)


def fingerprint(spark: SparkSession, settings: dict, inputs: Sequence[str]) -> str:
    """What a stage is made of; other settings, or inputs that have changed, give another."""
    known = {"settings": settings, "inputs": {p: files(spark, p) for p in inputs}}
    return hashlib.sha256(json.dumps(known, sort_keys=True).encode()).hexdigest()


def _own(spark: SparkSession, path: str) -> list[list]:
    return [[n, size] for n, size, _ in files(spark, path) if not n.endswith(f"/{MANIFEST}") and not n.rpartition("/")[2].startswith(".")]


def holds(spark: SparkSession, path: str, of: str) -> bool:
    """Whether the stage at path was written to its end with the fingerprint `of`."""
    fs, p = _of(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return False
    stream = fs.open(p)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except (ValueError, Py4JJavaError):  # no JSON, or a damaged file
        return False
    finally:
        stream.close()
    return said.get("fingerprint") == of and said.get("files") == _own(spark, path)


def clear(spark: SparkSession, *paths: str) -> None:
    """Takes stages away, their manifests first."""
    for path in paths:
        for name in (f"{path}/{MANIFEST}", path):
            fs, p = _of(spark, name)
            fs.delete(p, True)


def commit(spark: SparkSession, path: str, of: str) -> None:
    """Says that the stage at path is whole."""
    text = json.dumps({"fingerprint": of, "files": _own(spark, path)})
    fs, p = _of(spark, f"{path}/{MANIFEST}")
    _, draft = _of(spark, f"{path}/_draft.json")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(draft, p)
