"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are dealt by length, longest first, into parts of bounded size, so that a part has vectors of about one
length; within a part, buckets of BUCKET vectors go from the longest down. A query begins with the k-th best score
among the SEEDS longest vectors of all. For a bucket with longest vector l, a candidate must have a cosine of
threshold / (|q| l) at least:
- above 1 the bucket is passed over, and so are all later ones of the part;
- from TIGHT on, coordinates prune: the normed candidate must lie near the query in its largest coordinates;
- else length prunes: only candidates with |p| >= threshold / |q| are looked at.
What is left is verified with its exact integer product, and raises the query's threshold.

Queries are dealt into blocks by what a candidate's length must be for them, threshold / |q|. A block goes to those parts only
whose longest vector reaches the least such length in the block, and comes back with k rows a part at most.
Vectors equal in length are dealt by a hash of their row, so one very common vector fills many parts.

Components are whole numbers in doubles, exact at any size. Products that doubles can't hold exactly are made of
integers of any length; results are ranked by them, and shown as the nearest long where they go beyond one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallmap.llm.common import materialize

SCALE = 1024
SEEDS, SEED_BYTES = 4096, 8 << 20
PART_BYTES = 4 << 20
QUERY_BLOCK = 2048
BUCKET = 512
TIGHT = 0.6
FOCUS = 3
_EXACT = float(1 << 52)  # products below are whole numbers in doubles
_KEY_BYTES = 40  # of a score as a sorting key; no product of finite floats is longer
_ROW = "row long, vec_id long, dim int, norm double, v binary"


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row, vec_id, dim, norm, v: floor(1024 x) of each component, as doubles. Without the vectors that are null or have
    components that are null or not finite."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for row, id_, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if not x.is_valid or x.values.null_count:
                    continue
                x = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    a = np.floor(SCALE * x)
                    rows.append((row, id_, len(a), float(np.linalg.norm(a)), a.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row", "vec_id", "dim", "norm", "v"])

    slim = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return slim.mapInArrow(batches, _ROW)


def _matrix(v: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.to_pylist()), np.float64).reshape(len(v), dim)


def _products(q: np.ndarray, p: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of all q with all p: longs, or integers of any length as objects."""
    if bound < _EXACT:
        return (q @ p.T).astype(np.int64)
    whole = lambda a: np.array([[int(x) for x in row] for row in a.tolist()], object).reshape(a.shape)
    return whole(q) @ whole(p).T if q.shape[1] else np.zeros((len(q), len(p)), object)


def _below(score: int) -> float:
    """The greatest double that is not above a score."""
    f = float(score)
    return f if f <= score else math.nextafter(f, -math.inf)


def _key(score: int) -> bytes:
    """Bytes that sort as scores do."""
    return (score + (1 << (8 * _KEY_BYTES - 1))).to_bytes(_KEY_BYTES, "big")


class Best:
    """The k best of each query so far, and what a candidate must reach."""

    def __init__(self, thresholds: np.ndarray, k: int):
        self.k, self.low, self.found = k, thresholds.astype(np.float64), [[] for _ in thresholds]

    def add(self, i: int, scores: list[int], ids: list[int], nulls: list[bool]) -> None:
        have = self.found[i] + [(-s, n, v) for s, v, n in zip(scores, ids, nulls)]
        have.sort()
        self.found[i] = have[: self.k]
        if len(have) >= self.k:
            self.low[i] = max(self.low[i], _below(-have[self.k - 1][0]))


def search(q: np.ndarray, q_norm: np.ndarray, q_row: np.ndarray, low: np.ndarray, p: np.ndarray, norm: np.ndarray, row: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> Best:
    """The k best of p, longest first, for each q; only those that reach low. A query's own row doesn't count."""
    best = Best(low, k)
    long = np.maximum(q_norm, 1e-300)
    for start in range(0, len(p), BUCKET):
        part, l = slice(start, start + BUCKET), float(norm[start])
        slack = 1 + 1e-9
        # Thresholds of 0 or less prune nothing.
        active = np.flatnonzero((best.low <= 0) | (long * l * slack >= best.low))
        if not len(active):
            break
        unit = p[part] / np.maximum(norm[part], 1e-300)[:, None]
        need = np.where(best.low[active] > 0, best.low[active] / (long[active] * max(l, 1e-300)), -1.0)
        for i, t in zip(active[need >= TIGHT].tolist(), np.minimum(need[need >= TIGHT], 1.0).tolist()):
            u = q[i] / long[i]
            near = np.ones(len(unit), bool)
            for f in np.argsort(-np.abs(u))[:FOCUS].tolist():
                # Where a unit vector with a cosine of t or more to u can have this coordinate.
                wide = math.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-6
                low_end = -1.0 if -u[f] >= t else u[f] * t - wide
                high_end = 1.0 if u[f] >= t else u[f] * t + wide
                near &= (unit[:, f] >= low_end - 1e-6) & (unit[:, f] <= high_end + 1e-6)
            _verify(best, q, q_norm, q_row, np.array([i]), p, norm, row, ids, nulls, start + np.flatnonzero(near))
        loose = active[need < TIGHT]
        if len(loose):
            reach = best.low[loose] / long[loose]
            n = int(np.searchsorted(-norm[part], -reach.min() * (1 - 1e-9), side="right")) if reach.min() > 0 else len(unit)
            _verify(best, q, q_norm, q_row, loose, p, norm, row, ids, nulls, np.arange(start, start + n))
    return best


def _verify(best: Best, q: np.ndarray, q_norm: np.ndarray, q_row: np.ndarray, which: np.ndarray, p: np.ndarray, norm: np.ndarray, row: np.ndarray, ids: np.ndarray, nulls: np.ndarray, at: np.ndarray) -> None:
    if not len(at):
        return
    scores = _products(q[which], p[at], float(q_norm[which].max()) * float(norm[at].max()))
    good = (scores >= best.low[which][:, None]) & (row[at][None, :] != q_row[which][:, None])
    for j in np.flatnonzero(good.any(axis=1)).tolist():
        m = np.flatnonzero(good[j])
        if len(m) > best.k:  # ties at the edge all stay in play
            edge = np.sort(scores[j, m])[-best.k]
            m = m[scores[j, m] >= edge]
        best.add(int(which[j]), scores[j, m].tolist(), ids[at[m]].tolist(), nulls[at[m]].tolist())


def top(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row with an id divisible by `every`: query_id, rank, vec_id, score of the k rows with the highest
    integer inner products, its own row excepted; ties go to the smaller id, null ids last.

    Vectors that are null, or hold null or non-finite components take no part, on either side. Vectors
    of another number of components have no product with a query; without components it is 0. Fewer than k
    candidates: all. A repeated row is a candidate for its twin, and a query of its own. An empty table gives
    no rows. Other columns of df are not looked at.
    """
    vectors = materialize(_vectors(df, id_col, vector_col), "topk-vectors")
    n, dim = vectors.agg(F.count("*"), F.max("dim")).first()
    each = max(64, PART_BYTES // (8 * (dim or 1)))
    parts = max(1, -(-n // each))
    dealt = vectors.repartitionByRange(parts, F.col("dim"), F.col("norm").desc(), F.xxhash64("row"))
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "topk-parts")
    most = max(1, min(SEEDS, SEED_BYTES // (8 * (dim or 1))))
    seeds = vectors.orderBy(F.col("norm").desc(), "row").limit(most).collect()  # SEED_BYTES at most
    longest: dict[int, tuple] = {}
    for d in {r.dim for r in seeds}:
        own = [r for r in seeds if r.dim == d]
        longest[d] = (np.frombuffer(b"".join(r.v for r in own), np.float64).reshape(len(own), d), max(r.norm for r in own), np.array([r.row for r in own]))

    def thresholds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            low = []
            for row, d, norm, v in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("row", "dim", "norm", "v"))):
                p, most, rows = longest.get(d, (np.zeros((0, d)), 0.0, np.zeros(0, np.int64)))
                p = p[rows != row]
                scores = np.sort(_products(np.frombuffer(v, np.float64)[None, :], p, norm * most)[0])
                low.append(_below(int(scores[-k])) if len(scores) >= k else -math.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.float64())], names=[*b.schema.names, "low"])

    asked = vectors.where(F.col("vec_id") % every == 0).mapInArrow(thresholds, f"{_ROW}, low double")
    # How long a candidate must be at least; 0 where the threshold prunes nothing.
    needs = F.when((F.col("low") > 0) & (F.col("norm") > 0), F.col("low") / F.col("norm") * (1 - 1e-9)).otherwise(0.0)
    asked = materialize(asked.withColumn("needs", needs), "topk-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    q = asked.repartitionByRange(blocks, F.col("dim"), F.col("needs"), F.xxhash64("row")).withColumn("block", F.spark_partition_id())
    q = materialize(q, "topk-blocks")
    # A row for each part and for each block: which blocks a part may have something for.
    reach = dealt.groupBy("part", "dim").agg(F.max("norm").alias("reach"))
    least = q.groupBy("block", "dim").agg(F.min("needs").alias("least"))
    pairs = materialize(reach.join(least, "dim").where("reach >= least").select("part", "block", "dim"), "topk-pairs")
    p, q = dealt.join(pairs, ["part", "dim"]), q.join(pairs, ["block", "dim"])

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("norm", "descending"), ("row", "ascending")])
            d = left["dim"][0].as_py()
            nulls = left["vec_id"].is_null().to_numpy()
            ids = left["vec_id"].fill_null(0).to_numpy()
            got = search(
                _matrix(right["v"], d), right["norm"].to_numpy(), right["row"].to_numpy(), right["low"].to_numpy(),
                _matrix(left["v"], d), left["norm"].to_numpy(), left["row"].to_numpy(), ids, nulls, k,
            )
            for row, id_, found in zip(right["row"].to_pylist(), right["vec_id"].to_pylist(), got.found):
                out += [(row, id_, None if null else v, max(min(-s, (1 << 63) - 1), -(1 << 63)), _key(-s)) for s, null, v in found]
        cols = zip(*out) if out else [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row", "query_id", "vec_id", "score", "key"])

    keys = ["part", "block", "dim"]
    found = p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(best, "row long, query_id long, vec_id long, score long, key binary")
    order = Window.partitionBy("row").orderBy(F.col("key").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
