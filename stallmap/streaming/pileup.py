"""Pile-up of a stream of aligned blocks, for reads that arrive while a run goes on.

running_pileup() takes blocks in any order and keeps a count for each position. sorted_pileup() takes the stream of a file
sorted by coordinate: a position is given out once, when no later read can reach it, and what is kept is the blocks
that are still open there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stallmap.operators.pileup import read_start


def running_pileup(blocks: DataFrame, keys: tuple[str, ...] = ("contig", "strand")) -> DataFrame:
    """keys, pos, cov, rss so far; write it in update or complete mode. State is a row for each covered position,
    spread by key and position, so no contig is one task's."""
    pos = F.explode(F.sequence("start", F.col("end") - 1))
    bases = blocks.select(*keys, read_start().alias("at"), "ord", pos.alias("pos"))
    starts = ((F.col("at") == F.col("pos")) & (F.col("ord") == 1)).cast("long")
    return bases.groupBy(*keys, "pos").agg(F.count("*").alias("cov"), F.sum(starts).alias("rss"))


#: Of a sample: the contig at hand and its place in the order, how far its reads have come, and the open blocks, four numbers each.
_STATE = "rank long, contig string, front long, open binary"
_NUMBERS = ["start", "end", "begin", "minus"]
#: A block whose read's start has been given out already.
_GIVEN = np.iinfo(np.int64).min


def settled(blocks: np.ndarray, front: int | None) -> tuple[np.ndarray, np.ndarray]:
    """blocks of one contig (rows of start, end, begin: where the read starts or _GIVEN, minus: 1 on the - strand) -> rows of minus,
    pos, cov, rss at covered positions before front (all, if that is None), and what of the blocks is left from front on."""
    out = []
    limit = int(blocks[:, 1].max(initial=0)) if front is None else front
    for minus in (0, 1):
        own = blocks[(blocks[:, 3] == minus) & (blocks[:, 0] < limit)]
        if not len(own):
            continue
        end = np.minimum(own[:, 1], limit)
        edges = np.unique(np.concatenate([own[:, 0], end]))
        change = np.bincount(np.searchsorted(edges, own[:, 0]), minlength=len(edges)) - np.bincount(np.searchsorted(edges, end), minlength=len(edges))
        depth, width = np.cumsum(change)[:-1], np.diff(edges)
        pos = np.repeat(edges[:-1] - np.cumsum(width) + width, width) + np.arange(width.sum())
        cov = np.repeat(depth, width)
        pos, cov = pos[cov > 0], cov[cov > 0]
        begin = own[:, 2][(own[:, 2] != _GIVEN) & (own[:, 2] < limit)]
        rss = np.bincount(np.searchsorted(pos, begin), minlength=len(pos)) if len(pos) else pos
        out.append(np.stack([np.full(len(pos), minus), pos, cov, rss], axis=1))
    rest = blocks[blocks[:, 1] > limit].copy()
    rest[:, 2] = np.where((rest[:, 2] != _GIVEN) & (rest[:, 2] < limit), _GIVEN, rest[:, 2])
    rest[:, 0] = np.maximum(rest[:, 0], limit)
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64), rest


def sorted_pileup(blocks: DataFrame, sample: Sequence[str] = ("cond", "rep")) -> DataFrame:
    """A stream of blocks (sample, rank: the contig's place in the file's order, contig, strand, at: where the read's alignment begins,
    start, end, ord) -> sample, contig, strand, pos, cov, rss, in append mode.

    The blocks of a sample come sorted by rank and `at` from one micro-batch to the next, in any order within one; `at` is the least start
    of a read's blocks. A read that comes too late is an error, and the query stops. A row with a null contig says that the sample has
    ended: what is left is given out and its state goes. Of a contig nothing is left once the next has begun. State is the open blocks at
    one position of each sample; a task has one sample's part of a micro-batch, as the order of a file is that of one reader."""
    kinds = dict(blocks.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in sample)

    def put(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        ends, rows = rows["contig"].isna().any(), rows[rows["contig"].notna()].assign(minus=lambda x: x["strand"] == "-")
        rank, contig, front, held = state.get if state.exists else (-1, None, 0, b"")
        kept = np.frombuffer(held, np.int64).reshape(-1, len(_NUMBERS))
        if len(rows):
            first = rows.sort_values(["rank", "at"]).iloc[0]
            if contig is not None and (first["rank"], first["at"]) < (rank, front):
                raise ValueError(f"{key}: a read at {first['contig']}:{first['at']} comes after {contig}:{front}")
        found = []

        def give(of: str, done: np.ndarray) -> None:
            if len(done):
                named = dict(zip(sample, key)) | {"contig": of, "strand": np.where(done[:, 0] == 1, "-", "+"), "pos": done[:, 1], "cov": done[:, 2], "rss": done[:, 3]}
                found.append(pd.DataFrame(named))

        for r, own in rows.groupby("rank", sort=True):
            if contig is not None and r != rank:
                give(contig, settled(kept, None)[0])
                kept = kept[:0]
            start, end, minus = (own[c].to_numpy().astype(np.int64) for c in ("start", "end", "minus"))
            begin = np.where(own["ord"] == 1, np.where(minus == 1, end - 1, start), np.int64(_GIVEN))
            new = np.stack([start, end, begin, minus], axis=1)
            rank, contig, front = int(r), own["contig"].iloc[0], int(own["at"].max())
            done, kept = settled(np.concatenate([kept, new]), front)
            give(contig, done)
        if ends:
            if contig is not None:
                give(contig, settled(kept, None)[0])
            state.remove()
        elif contig is not None:
            state.update((rank, contig, front, kept.tobytes()))
        yield from found

    out = f"{keys}, contig string, strand string, pos int, cov long, rss long"
    return blocks.select(*sample, "rank", "contig", "strand", "at", "start", "end", "ord").groupBy(*sample).applyInPandasWithState(put, out, _STATE, "append", GroupStateTimeout.NoTimeout)
