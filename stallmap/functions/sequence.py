"""Column functions on nucleotide sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def count_of(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def is_whitelisted(window: Column) -> Column:
    """A stop can be called after this window: 3 bases at least, a G in the last three, and GG or three Gs."""
    return (F.length(window) >= 3) & F.contains(F.right(window, F.lit(3)), F.lit("G")) & (F.contains(window, F.lit("GG")) | (count_of(window, "G") >= 3))


def whitelisted_after(bases: np.ndarray, width: int) -> np.ndarray:
    """is_whitelisted() of each window of `width` (3 at least) of bases, by where it starts."""
    if len(bases) < width:
        return np.zeros(0, bool)
    g = bases == ord("G")
    count = np.concatenate([[0], np.cumsum(g, dtype=np.int32)])
    pairs = np.concatenate([[0], np.cumsum(g[:-1] & g[1:], dtype=np.int32)])
    return (count[width:] > count[width - 3 : -3]) & ((pairs[width - 1 :] > pairs[: len(pairs) - width + 1]) | (count[width:] - count[:-width] >= 3))


def g_percent(window: Column) -> Column:
    """Highest G share, in per cent, of a suffix of the window; suffix i counts as 50 - i bases, i = 0 ... 39."""
    share = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.lit(100.0) * count_of(F.substring(window, i + 1, F.length(window)), "G") / (F.lit(50) - i))
    return F.array_max(share)


def g_runs(window: Column) -> Column:
    """G tracts: maximal runs of two or more, those of six or more count twice. 4 means four or more; null if
    there are fewer than three or more than two bases follow the last."""
    runs = F.regexp_extract_all(window, F.lit("(G{2,})"), F.lit(1))
    n = F.aggregate(runs, F.lit(0), lambda a, r: a + F.when(F.length(r) >= 6, 2).otherwise(1))
    tail = F.length(F.regexp_replace(window, "^.*GG", ""))
    return F.when((tail <= 2) & (n >= 3), F.least(n, F.lit(4)))


def novel_verdict(window: Column) -> Column:
    """What the bases before a stop say where no motif is: by their G share, then by their tracts."""
    runs = g_runs(window)
    rich = F.when(runs >= 4, "potential G-quadruplex & G>=40%").when(runs == 3, "potential G-triplex & G>=40%").otherwise("G>=40%")
    return F.when(g_percent(window) >= 40, rich).otherwise("Unknown")
