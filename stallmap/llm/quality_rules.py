"""Quality rules: counts that any clean text passes, then a log-likelihood ratio of hashed n-grams.

The n-grams are runs of GRAM bytes of the text with its white space made single, hashed to BUCKETS buckets.
Two multinomials are counted over all rows, one of the trusted documents and one of the whole corpus, with one
added to every bucket. A document's ratio is the mean of log(trusted / corpus) over its n-grams, and it passes
if that is at least THRESHOLD; nothing is sampled, so a document's verdict is the same on every run.

The counts are BUCKETS rows at most for each task, then in all: they are added up by a partial aggregate, and
what reaches the driver and goes out with the tasks is one number a bucket, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmap.llm.common import small

GRAM = 4
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
THRESHOLD = -0.5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
WINDOW = 5
MANY_TRUSTED = 2_000_000
_PIECE = 1 << 21
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def grams(data: bytes) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, some millions at a time."""
    text = np.frombuffer(b" " + b" ".join(data.split()) + b" ", np.uint8)
    for k in range(0, len(text) - GRAM + 1, _PIECE):
        part = text[k : k + _PIECE + GRAM - 1].astype(np.uint32)
        n = len(part) - GRAM + 1
        value = sum(part[i : i + n] << np.uint32(8 * i) for i in range(GRAM))
        yield (value * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    runs, count = ids, np.zeros(0)
    for i in range(1, window):  # exact numbers for runs of i + 1 words
        runs = runs[:-1] * len(numbers) + ids[i:]
        _, runs, count = np.unique(runs, return_inverse=True, return_counts=True)
        if i < window - 1 and len(count) == len(runs):
            return 0  # no shorter run repeats, so no window does
    hit = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(count[runs] > 1)
    np.add.at(hit, again, 1)
    np.add.at(hit, again + window, -1)
    return int((np.cumsum(hit) > 0).sum())


def features(data: bytes) -> tuple[int, int, int, int, int, bool]:
    words, raw = data.split(), np.frombuffer(data, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum()) - int(((raw == 32) | ((raw >= 9) & (raw <= 13))).sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * again > MOST_REPEATED * len(words)
    return len(words), chars, int(_SYMBOLS[raw].sum()), len(lines) - len(set(lines)), again, failed


def ratio(data: bytes, weights: np.ndarray) -> float:
    total = n = 0
    for b in grams(data):
        total, n = total + float(weights[b].sum()), n + len(b)
    return total / n if n else 0.0


def log_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(trusted / corpus) of every bucket. trusted: a column doc_id; nulls and repeats in it don't count."""
    mark = trusted.select(F.col("doc_id").alias("its")).where("its is not null").distinct().withColumn("trusted", F.lit(True))
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(mark, MANY_TRUSTED), F.col("id") == F.col("its"), "left")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in it:
            for data, good in zip(b.column(0).cast(pa.large_binary()).to_pylist(), b.column(1).to_pylist()):
                for g in grams(data or b""):
                    n = np.bincount(g, minlength=BUCKETS)
                    corpus += n
                    if good:
                        target += n
        some = np.flatnonzero(corpus)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(corpus[some]), pa.array(target[some])], names=["bucket", "corpus", "target"])

    counts = marked.select("text", "trusted").mapInArrow(count, "bucket int, corpus long, target long")
    summed = counts.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target")).collect()
    both = np.ones((2, BUCKETS))
    for r in summed:
        both[:, r.bucket] += (r.target, r.corpus)
    return np.log(both[0] / both[0].sum()) - np.log(both[1] / both[1].sum()) if any(r.target for r in summed) else np.zeros(BUCKETS)


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, the counts of features(), base_failed, ratio, kept.

    Null text: as an empty one, without words, so it fails. Very long texts are counted whole. A ratio equal to the threshold stays. Without any trusted document every ratio is 0 and
    the counts alone decide. Repeated rows and null ids keep a row each. An empty table gives no rows. Other
    columns of docs are not looked at.
    """
    weights = log_weights(docs, trusted, id_col, text_col).astype(np.float32)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for data in b.column(1).cast(pa.large_binary()).to_pylist():
                f, r = features(data or b""), ratio(data or b"", weights)
                rows.append((*f, r, not f[-1] and r >= threshold))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            cols = [pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)]
            names = ["doc_id", *(x.split()[0] for x in FEATURES.split(", ")), "ratio", "kept"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(batches, f"doc_id {dict(slim.dtypes)['doc_id']}, {FEATURES}, ratio double, kept boolean")


def kept(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns and no others; documents aren't shuffled.
    Nulls, ties, long texts and empty tables are as in judge(); columns of any name stay."""
    weights = log_weights(docs, trusted, id_col, text_col).astype(np.float32)
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [x or b"" for x in b.column(at).cast(pa.large_binary()).to_pylist()]
            yield b.filter(pa.array([not features(x)[-1] and ratio(x, weights) >= threshold for x in texts], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
