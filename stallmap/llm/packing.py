"""Best-fit packing into bins of several permitted lengths.

A document takes its words and one separator; what is longer than the longest length is cut into pieces. Pieces
go longest first. Each goes into the open bin that it fills best; if none has room, a bin is opened with the
length of least cost for each token it can be expected to hold, cost being length, attention and a fixed part. When
all are packed, each bin shrinks to the shortest permitted length that holds its contents.

Which lengths may be opened is decided for all of them together: a group is packed with every choice of them that has
room for its longest piece, and the packing of least total cost, after shrinking, is kept.

Pieces are dealt out evenly (by a round-robin exchange of slim rows, no text and no key, so nothing is skewed)
into groups of about GROUP pieces, and each group is packed by itself. A group is what a task holds in memory;
their number grows with the input. The unfilled room this leaves is that of the last few bins of each group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmap.llm.common import materialize, n_words

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP = 20_000
BIN_COST = 256
ATTENTION_SPAN = 16_384


def cost(length: int) -> float:
    return length + length * length / ATTENTION_SPAN + BIN_COST


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, final: Sequence[int] = ()) -> tuple[list[int], list[int], list[int]]:
    """sizes, longest first -> the bin of each, its offset in the bin, and the final length of each bin, one of `final` (lengths,
    if that is empty); bins are opened with one of lengths.

    Of bins filled equally well, the one opened first is taken."""
    lengths, final = sorted(lengths), sorted(final or lengths)
    ahead, room, bins, offsets = sum(sizes), {}, [], []
    free: list[int] = []  # the different amounts of room of open bins, in order
    held: list[int] = []
    opened: list[int] = []
    for s in sizes:
        at = bisect_left(free, s)
        if at < len(free):
            left = free[at]
            which = room[left].pop(0)
            if not room[left]:
                del room[left], free[at]
        else:
            fits = [c for c in lengths if c >= s]
            length = min(fits, key=lambda c: (cost(c) / min(c, ahead), c))
            which, left = len(held), length
            held.append(0)
            opened.append(length)
        bins.append(which)
        offsets.append(held[which])
        held[which] += s
        ahead -= s
        if left := left - s:
            if left not in room:
                room[left] = []
                insort(free, left)
            insort(room[left], which)
    return bins, offsets, [next(c for c in final if c >= n) for n in held]


def least_cost(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """best_fit() with the choice of opened lengths whose final bins cost least; ties to fewer, then shorter ones."""
    most, tried = max(sizes, default=0), []
    for n in range(1, len(lengths) + 1):
        for own in combinations(sorted(lengths), n):
            if own[-1] >= most:
                got = best_fit(sizes, own, lengths)
                tried.append((sum(map(cost, got[2])), got))
    return min(tried, key=lambda x: x[0])[1]


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each row of docs: doc_id, piece, first_word, size, bin, bin_length, offset.

    size counts the words of the piece, and the separator after a document's last one. Null and empty texts are
    one piece, the separator alone. Very long texts are as many pieces as they need. Repeated rows and null ids are packed each by itself. An empty table gives
    no rows. Other columns of docs are not looked at.
    """
    longest = max(lengths)
    total = n_words(F.col(text_col)) + 1
    slim = docs.select(F.col(id_col).alias("doc_id"), total.alias("total"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(longest).cast("long")))
    pieces = slim.select("doc_id", "total", first.alias("first_word"))
    pieces = materialize(pieces.select("doc_id", "first_word", F.least(F.col("total") - F.col("first_word"), F.lit(longest)).cast("int").alias("size")), "pack-pieces")
    groups = max(1, -(-pieces.count() // group))

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in it if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).sort_by([("size", "descending"), ("doc_id", "ascending"), ("first_word", "ascending")])
        bins, offsets, final = least_cost(rows["size"].to_pylist(), lengths)
        own = np.array(bins, np.int64)
        whole = [
            rows["doc_id"].combine_chunks(),
            pa.array((rows["first_word"].to_numpy() // longest).astype(np.int32)),
            rows["first_word"].combine_chunks(),
            rows["size"].combine_chunks(),
            pa.array((TaskContext.get().partitionId() << 32) + own),
            pa.array(np.array(final, np.int32)[own]),
            pa.array(np.array(offsets, np.int32)),
        ]
        names = ["doc_id", "piece", "first_word", "size", "bin", "bin_length", "offset"]
        yield from pa.table(dict(zip(names, whole))).to_batches()

    kind = dict(slim.dtypes)["doc_id"]
    return pieces.repartition(groups).mapInArrow(packed, f"doc_id {kind}, piece int, first_word long, size int, bin long, bin_length int, offset int")
