"""Sharding: contiguous shards of near-equal bytes, never splitting equal texts.

Rows are dealt by a hash of their text into CELLS cells of equal hash ranges. A cell is the atomic group: all rows of one
text are in one cell. Cells are put in an order that allows near-equal cuts: from the largest down each goes to the
lightest of as many stacks as there are shards, and the stacks stand one after another. Then a binary search finds the
smallest capacity with which filling shards greedily in that order needs no more shards than asked for; the cuts
go as near to equal shares as this capacity allows.

Cells that alone hold more than a fair share (a text with a third of all rows, say) can't be made smaller
without splitting equal texts. They stand first in the order, one shard each; the search is over the rest.

What reaches the driver is the sizes of the cells, CELLS rows at most whatever the input, and what goes back is the shard
of each cell. Slots are numbered in sub-cells of a bounded number of rows, so that a hot text is numbered by many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heapify, heapreplace
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallmap.llm.common import materialize

CELLS = 1 << 16
ROW_BYTES = 16


def feasible(prefix: list[int], start: int, capacity: int, shards: int) -> bool:
    """Whether the groups after start fit into so many contiguous shards. prefix: running sizes from 0."""
    at, last = start, len(prefix) - 1
    for _ in range(shards):
        if at == last:
            return True
        at = bisect_right(prefix, prefix[at] + capacity) - 1
    return at == last


def smallest_capacity(prefix: list[int], shards: int) -> int:
    """The minimax capacity: the least for which a greedy fill needs at most so many shards."""
    total = prefix[-1]
    low, high = max((b - a for a, b in zip(prefix, prefix[1:])), default=0), total
    low = min(max(low, -(-total // shards)), high)
    while low < high:
        middle = (low + high) // 2
        if feasible(prefix, 0, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """Start positions of the shards but the first. No shard exceeds the minimax capacity; within it each
    cut is as near as can be to an equal share of the whole."""
    if shards < 2:
        return []
    prefix = [0, *accumulate(sizes)]
    capacity, last = smallest_capacity(prefix, shards), len(sizes)
    least = [last]  # the earliest start with which the rest still fits, from the last shard backwards
    for _ in range(shards - 1):
        least.append(bisect_left(prefix, prefix[least[-1]] - capacity))
    cuts, at = [], 0
    for k in range(1, shards):
        low, high = max(at, least[shards - k]), bisect_right(prefix, prefix[at] + capacity) - 1
        ideal = prefix[-1] * k / shards
        near = bisect_left(prefix, ideal)
        if near and ideal - prefix[near - 1] <= prefix[min(near, last)] - ideal:
            near -= 1
        at = min(max(near, low), high)
        cuts.append(at)
    return cuts


def ordered(cells: list[tuple[int, int]], stacks: int) -> list[tuple[int, int]]:
    """(cell, bytes) in the order of the shards: the largest first, each on the lightest stack; ties by cell."""
    light = [(0, i) for i in range(stacks)]
    heapify(light)
    piles: list[list] = [[] for _ in range(stacks)]
    for cell in sorted(cells, key=lambda x: (-x[1], x[0])):
        held, i = light[0]
        piles[i].append(cell)
        heapreplace(light, (held + cell[1], i))
    return [x for pile in piles for x in pile]


def plan(cells: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """From (cell, bytes): the shard of each cell."""
    rest, alone = sorted(cells, key=lambda x: (-x[1], x[0])), []
    total = sum(x[1] for x in rest)
    while len(alone) < shards - 1 and len(alone) < len(rest) - 1 and rest[len(alone)][1] * (shards - len(alone)) > total:
        total -= rest[len(alone)][1]
        alone.append(rest[len(alone)])
    row = ordered(rest[len(alone) :], shards - len(alone))
    starts = cut([x[1] for x in row], shards - len(alone))
    of = {cell: k for k, (cell, _) in enumerate(alone)}
    return of | {cell: len(alone) + bisect_right(starts, i) for i, (cell, _) in enumerate(row)}


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, shard, slot.

    size: bytes of the text in UTF-8 plus ROW_BYTES. Null text: as an empty one, and in its group. Equal
    texts share a shard. slot: 0, 1, ... within each shard, without gaps. Repeated rows and null ids keep
    a row and a slot each. Very long texts are rows like any other. An empty table gives no rows. Other columns of docs are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "shard-rows",
    ).withColumn("cell", F.shiftrightunsigned("h", 48).cast("int"))

    cells = materialize(rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-cells")
    known = cells.collect()  # CELLS rows at most
    shard_of = plan([(r.cell, r.bytes) for r in known], shards)
    # One number a cell, as a table made in the JVM.
    numbers = F.lit(",".join(str(shard_of.get(c, 0)) for c in range(CELLS)))
    place = docs.sparkSession.range(1).select(F.posexplode(F.split(numbers, ",")).alias("cell", "shard")).withColumn("shard", F.col("shard").cast("int"))

    # Sub-cells of at most about `most` rows: no more than CELLS * 1.25 of them.
    most = max(256, 4 * sum(r.n for r in known) // CELLS)
    parts = cells.join(F.broadcast(place), "cell").select("cell", "shard", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")).cast("int"))
    in_shard = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "cell", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(in_shard), F.lit(0)))
        .select("cell", "part", "offset")
    )
    in_part = Window.partitionBy("cell", "part").orderBy("h", "doc_id", "size", "row")
    return (
        rows.withColumn("nth", F.row_number().over(in_part))
        .join(F.broadcast(offsets), ["cell", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"))
    )
