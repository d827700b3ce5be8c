"""Hard-negative mining: exact integer scores by a residue-number system, then a window of scores for each positive.

Vectors become rows of whole numbers. A block of anchors meets a part of the candidates as two matrices, which are multiplied modulo
several primes in float32: the residues, between -p/2 and p/2, are so small that no sum of COLUMNS products reaches 2 ** 24, so
every float32 sum is exact. As many primes are taken as the largest possible score, |anchor| |candidate|, needs. The signed score comes
back by Chinese remaindering, digit by digit in the mixed base of the primes; in 64 bits where it fits, else in integers of any length.

First each anchor's positives: the POSITIVES best rows of its own label. Anchors and candidates are dealt by a hash of their label into
buckets, and these into blocks and parts of bounded size, so blocks meet only parts of their bucket here, and a common label is many parts. Then
all blocks meet all parts of the same number of components, and of each part the best NEGATIVES rows of another label come back
for each positive whose score lies in the positive's window. What remains is ranked over the parts.

The second step is quadratic by contract: a fiftieth of the rows against all. No part, block or result of a task grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallmap.llm.common import materialize, small

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LEAST, MOST = 50, 95
#: Candidates of a part (fewer if they have many components), and anchors of a block.
PART, PART_BYTES, BLOCK = 4096, 8 << 20, 1024
BUCKETS = 64
#: Components that are multiplied in one go; primes stay below 2 * sqrt(2 ** 24 / columns). With few columns there are more
#: primes, enough for the products of any doubles.
COLUMNS, FEW_COLUMNS = 256, 16
_LIMIT = (1 << 63) - 1
_NONE = -(1 << 63)
_ROW = "row long, vec_id long, label int, dim int, norm double, v binary"


def primes(columns: int = COLUMNS) -> list[int]:
    """Odd primes, largest first, whose residues' products over so many columns float32 adds up exactly."""
    most = 2 * math.isqrt((1 << 24) // columns)
    return [n for n in range(most - 1, 2, -1) if all(n % d for d in range(2, math.isqrt(n) + 1))]


def _needed(bound: float) -> tuple[list[int], int]:
    """Primes whose product is over twice the bound, and the columns that they allow."""
    whole = 2 * int(bound * (1 + 1e-9) if isinstance(bound, float) else bound) + 3
    for columns in (COLUMNS, FEW_COLUMNS):
        product, out = 1, []
        for p in primes(columns):
            product *= p
            out.append(p)
            if product > whole:
                return out, columns
    raise OverflowError("no product of doubles is that long")


def residues(a: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers in doubles -> the residues of least absolute value, as float32. fmod is exact for doubles of any size."""
    r = np.fmod(a, p)
    r -= p * (r > p // 2)
    r += p * (r < -(p // 2))
    return r.astype(np.float32)


def products(q: np.ndarray, p: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of all rows of q and p, whole numbers in doubles, none above the bound: longs, or integers of any
    length as objects where the primes that the bound needs don't fit in 62 bits."""
    (base, columns), out, digits = _needed(bound), None, []
    wide = math.prod(base).bit_length() > 62
    for k, prime in enumerate(base):
        total = np.zeros((len(q), len(p)), np.int32)
        a, b = residues(q, prime), residues(p, prime)
        for at in range(0, q.shape[1], columns):
            total += (a[:, at : at + columns] @ b[:, at : at + columns].T).astype(np.int32) % prime
        digit = total.astype(np.int64)
        # What the digits so far leave of the residue, in units of the primes so far.
        for own, d in zip(base[:k], digits):
            digit = (digit - d) * pow(own, -1, prime) % prime
        digits.append(digit % prime)
    for prime, digit in zip(reversed(base), reversed(digits)):
        digit = digit.astype(object) if wide else digit
        out = digit if out is None else out * prime + digit
    product = math.prod(base)
    return np.where(out > product // 2, out - product, out)


def _exceeding(score: int) -> str | None:
    """A score beyond a long as text that sorts as such scores do, else null."""
    if abs(score) < _LIMIT:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"+{len(digits):04d}{digits}"
    return f"-{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _exact(score: int, exceeding: str | None) -> int:
    if exceeding is None:
        return score
    digits = exceeding[5:]
    return int(digits) if exceeding[0] == "+" else -int(digits.translate(str.maketrans("0123456789", "9876543210")))


def _fitting(score: int) -> int:
    return max(min(score, _LIMIT), -_LIMIT)


def _vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, every: int, classes: int) -> DataFrame:
    """_ROW of the rows that take part: v is floor(SCALE x) of each component, as 16-bit numbers if they fit, else doubles."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for row, id_, label, x in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                if x.values.null_count:
                    continue
                x = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    a = np.floor(SCALE * x)
                    norm = float(np.linalg.norm(a))
                if np.isfinite(a).all():
                    most = np.abs(a).max(initial=0)
                    norm = norm if math.isfinite(norm) else float(most) * math.sqrt(len(a)) if most < 1e300 else math.inf
                    rows.append((row, id_, label, len(a), norm, (a.astype("<i2") if most < 1 << 15 else a.astype("<f8")).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
            cols = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row", "vec_id", "label", "dim", "norm", "v"])

    id_, label = F.col(id_col).cast("long"), F.col(label_col).cast("int")
    moved = F.when(id_ % every == 0, (label + 1) % classes).otherwise(label)
    slim = df.select(F.monotonically_increasing_id().alias("row"), id_.alias("vec_id"), moved.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return slim.where("label is not null and v is not null").mapInArrow(batches, _ROW)


def _matrix(rows: pa.Table, dim: int) -> np.ndarray:
    out = np.zeros((rows.num_rows, dim))
    for k, v in enumerate(rows["v"].to_pylist()):
        out[k] = np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<f8")
    return out


def _first(scores: np.ndarray, ok: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores with an ok place: its number, and its k best ok places, the earlier one first if scores are equal."""
    none = -math.inf if scores.dtype == object else _NONE
    s = np.where(ok, scores, none)
    edge = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), none, s.dtype)
    for i in np.flatnonzero(ok.any(axis=1)).tolist():
        at = np.flatnonzero(ok[i] & (s[i] >= edge[i]))
        own = s[i, at]
        yield i, at[np.argsort(-own, kind="stable")[:k]]


def _dealt(rows: DataFrame, name: str, most) -> DataFrame:
    """rows with a column `name`: their part among those of their bucket, of at most about most(dim) rows each."""
    kind, cells = ["dim", "bucket"], rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"))
    cells = small(cells.select("dim", "bucket", F.ceil(F.col("n") / most(F.col("dim"))).alias("parts")), 100_000)
    return rows.join(cells, kind).withColumn(name, F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")


def mine(
    df: DataFrame, every: int = 50, relabel_every: int = 7, classes: int = 10, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (id divisible by `every`) and each
    of its first positives, the first negatives, rows of another label with least * positive <= 100 * negative <= most * positive.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do vectors whose scaled components are
    beyond a double. Higher scores come first, then smaller ids, null ids last, then any order. Vectors of different numbers of components have no
    score; without components it is 0. Scores beyond a long are ranked exactly and shown as the nearest long. A repeated row is a
    row: a positive of its twin, and an anchor of its own. Positives with a negative score have no window. A pair without negatives gives
    no row; an empty table gives none. Other columns of df are not looked at.
    """
    rows = _vectors(df, id_col, vector_col, label_col, relabel_every, classes)
    rows = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")), "negatives-vectors")
    size = lambda dim: F.greatest(F.lit(1), F.least(F.lit(PART), F.floor(F.lit(PART_BYTES) / (8 * (dim + 1)))))
    parts = materialize(_dealt(rows, "part", size), "negatives-parts")
    anchors = materialize(_dealt(rows.where(F.col("vec_id") % every == 0), "block", lambda dim: F.least(F.lit(BLOCK), size(dim))), "negatives-anchors")

    def sides(left: pa.Table, right: pa.Table) -> tuple:
        """Candidates by id, and the scores of all anchors with them."""
        order = np.lexsort((left["row"].to_numpy(), left["vec_id"].fill_null(0).to_numpy(), left["vec_id"].is_null().to_numpy()))
        left, dim = left.take(pa.array(order)), left["dim"][0].as_py()
        a, p = _matrix(right, dim), _matrix(left, dim)
        bound = float(right["norm"].to_numpy().max()) * float(left["norm"].to_numpy().max())
        if not bound < 1e150:
            bound = int(np.abs(a).max(initial=0)) * int(np.abs(p).max(initial=0)) * max(1, dim)
        return left, products(a, p, bound)

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left, scores = sides(left, right)
            row, label, ids = left["row"].to_numpy(), left["label"].to_numpy(), left["vec_id"].to_pylist()
            own, named = right["row"].to_pylist(), right["label"].to_numpy()
            ok = (label[None, :] == named[:, None]) & (row[None, :] != right["row"].to_numpy()[:, None])
            for i, at in _first(scores, ok, positives):
                out += [(own[i], int(row[j]), ids[j], _fitting(s := int(scores[i, j])), _exceeding(s)) for j in at.tolist()]
        cols = zip(*out) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "positive", "positive_id", "score", "exceeding"])

    def met(p: DataFrame, a: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """Both sides, once for each other that has the same keys."""
        pairs = p.select("dim", "bucket", "part").distinct().withColumnRenamed("bucket", "of_part")
        other = a.select("dim", "bucket", "block").distinct().withColumnRenamed("bucket", "of_block")
        pairs = pairs.withColumn("bucket", F.col("of_part")).join(other.withColumn("bucket", F.col("of_block")), keys).select("dim", "of_part", "part", "of_block", "block")
        pairs = materialize(pairs, "negatives-pairs")
        return p.withColumnRenamed("bucket", "of_part").join(pairs, ["dim", "of_part", "part"]), a.withColumnRenamed("bucket", "of_block").join(pairs, ["dim", "of_block", "block"])

    cell = ["dim", "of_part", "part", "of_block", "block"]
    order = [F.col("score").desc(), F.col("exceeding").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    p, a = met(parts, anchors, ["dim", "bucket"])
    found = p.groupBy(*cell).cogroup(a.groupBy(*cell)).applyInArrow(best, "anchor long, positive long, positive_id long, score long, exceeding string")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("exceeding").desc(), F.col("positive_id").asc_nulls_last(), "positive"))
    found = materialize(found.withColumn("place", place).where(F.col("place") <= positives).where("score >= 0"), "negatives-positives")
    held = found.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("place", "score", "exceeding")).alias("positives"))  # `positives` at most
    anchors = materialize(anchors.join(held, "row"), "negatives-asking")

    def windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left, scores = sides(left, right)
            row, label, ids, whole = left["row"].to_numpy(), left["label"].to_numpy(), left["vec_id"].to_pylist(), scores.dtype == object
            own, asked = right["row"].to_pylist(), right["positives"].to_pylist()
            other = label[None, :] != right["label"].to_numpy()[:, None]
            for n in range(max(map(len, asked))):
                exact = [_exact(x[n]["score"], x[n]["exceeding"]) if n < len(x) else -1 for x in asked]  # a window of -1 is empty
                # The whole numbers of the window; what a long doesn't hold is no score here.
                low, high = ([-(-least * e // 100) for e in exact], [most * e // 100 for e in exact])
                kept = (lambda x: np.array(x, object)) if whole else (lambda x: np.array([_fitting(v) for v in x], np.int64))
                ok = other & (scores >= kept(low)[:, None]) & (scores <= kept(high)[:, None]) & (np.array(low, object) <= np.array(high, object)).astype(bool)[:, None]
                for i, at in _first(scores, ok, negatives):
                    out += [(own[i], asked[i][n]["place"], int(row[j]), ids[j], _fitting(s := int(scores[i, j])), _exceeding(s)) for j in at.tolist()]
        cols = zip(*out) if out else [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "place", "row", "vec_id", "score", "exceeding"])

    p, a = met(parts, anchors, ["dim"])
    got = p.groupBy(*cell).cogroup(a.groupBy(*cell)).applyInArrow(windows, "anchor long, place int, row long, vec_id long, score long, exceeding string")
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    named = found.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select("anchor", "place", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    got = got.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return got.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
