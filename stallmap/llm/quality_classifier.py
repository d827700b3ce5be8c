"""Quality classifier by compression: is a text more like good or like bad text?

Two zstandard dictionaries are trained, on good and on bad labelled text. A text is cut into pieces of PIECE
bytes, so that the dictionaries matter for long texts too; all pieces are compressed with either dictionary,
and the difference of the compressed sizes over the size of the text becomes a probability by a logistic fit.

Only the fit works on a sample: FIT_ROWS labelled rows a class at most, of texts of at most FIT_CHARS
characters, chosen by a hash. Half of them train the dictionaries and the other half the logistic curve, which
so sees texts that the dictionaries haven't. Labels of rows in the held-out fold are never read. Every document
is scored, whole, by its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 3000
FIT_CHARS = 16_384
DICT_BYTES = 112_640
SAMPLE = 2048
PIECE = 512
LEVEL = 3
CUT = 0.7
FOLDS, HELD_OUT = 4, 2


def held_out(id_: Column) -> Column:
    """Whether a row is in the fold whose labels aren't used; null ids are not."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _dictionary(texts: list[bytes]) -> bytes:
    """Bytes of a dictionary: trained, or the texts themselves if they are too few to train one."""
    pieces = [t[i : i + SAMPLE] for t in texts for i in range(0, len(t), SAMPLE)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 1.0
    offset: float = 0.0

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if "ready" not in self.__dict__:
            plain = {"level": LEVEL, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
            dicts = [zstandard.ZstdCompressionDict(x) if x else None for x in (self.good, self.bad)]
            for d in dicts:
                if d:
                    d.precompute_compress(level=LEVEL)
            self.__dict__["ready"] = [zstandard.ZstdCompressor(dict_data=d, **plain) for d in dicts]
        return self.__dict__["ready"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ready"}

    def difference(self, data: bytes) -> float:
        """Compressed size with the dictionary of bad text, less that with good, over the size of the text."""
        good, bad = (x.compress for x in self._compressors())
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return sum(len(bad(p)) - len(good(p)) for p in pieces) / max(1, len(data))

    def score(self, data: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(data) + self.offset, -50, 50))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and offset of the logistic fit of y on x, by damped Newton steps."""
    scale = float(x.std()) or 1.0
    rows, w = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -50, 50)))
        hess = (rows * (p * (1 - p))[:, None]).T @ rows / len(x) + ridge * np.eye(2)
        step = np.linalg.solve(hess, rows.T @ (p - y) / len(x) + ridge * w)
        w -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model, from labels (doc_id, quality 0 or 1; other values and nulls don't count).

    Null and empty texts, and those of over FIT_CHARS characters, take no part; nor do null ids. Of more rows than FIT_ROWS a class those
    with the least hashes are taken, so ties are broken alike on every run; repeated rows may be taken twice. Empty tables, and labels of
    one class, give a model with one score for all. Other columns are not looked at.
    """
    marks = labels.select(F.col("doc_id").alias("its"), F.col("quality").alias("mark")).where("its is not null and mark in (0, 1)")
    marks = marks.where(~held_out(F.col("its"))).distinct()
    chosen = [marks.where(F.col("mark") == c).orderBy(F.xxhash64("its"), "its").limit(2 * FIT_ROWS) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 4 * FIT_ROWS rows at most
    text = F.col("text")
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length(text).between(1, FIT_CHARS))
    known = known.join(ids, F.col("id") == F.col("its")).select("id", "mark", "text", F.xxhash64("id", "text").alias("h"))
    rows = [r for c in (0, 1) for r in known.where(F.col("mark") == c).orderBy("h", "id").limit(FIT_ROWS).collect()]
    of = lambda c, half: [r.text.encode() for r in rows if r.mark == c and (r.h >> 7) & 1 == half]
    model = Model(_dictionary(of(1, 0)), _dictionary(of(0, 0)))
    x = [(model.difference(t), c) for c in (0, 1) for t in of(c, 1)]
    if {c for _, c in x} == {0, 1}:
        model.slope, model.offset = fit_curve(*(np.array(v, float) for v in zip(*x)))
        # The sample has the classes in other shares than the labels have.
        share, all_ = [sum(c == k for _, c in x) for k in (0, 1)], {r.mark: r["count"] for r in marks.groupBy("mark").count().collect()}
        model.offset += float(np.log(all_[1] / all_[0] * share[0] / share[1]))
    elif x:  # one class alone: all the same
        model.slope, model.offset = 0.0, 5.0 if x[0][1] else -5.0
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= CUT).

    Very long texts are scored whole. Null text: as an empty one, which has no difference in size and gets the curve's value at 0. Without
    labels of both classes all scores are alike. Repeated rows and null ids keep a row each. An empty table
    gives no rows. Other columns of docs are not looked at.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = pa.array([model.score(x or b"") for x in b.column(1).cast(pa.large_binary()).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=["doc_id", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = slim.mapInArrow(batches, f"doc_id {dict(slim.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of CUT or more, with all their columns and no others. Null and empty texts are scored as in
    score(); very long ones are scored whole, piece by piece. Repeated rows stay or go together. An empty table gives no rows."""
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(at).cast(pa.large_binary()).to_pylist()
            yield b.filter(pa.array([model.score(x or b"") >= CUT for x in texts], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
