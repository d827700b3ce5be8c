"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all its variants within half the radius (for radius 4: itself and all
fingerprints one or two bits away, 2081). Two fingerprints at most radius bits apart have a variant in
common, so a shuffle on variants brings each such pair together; what meets is made distinct and verified.

The shuffle is on groups of variants, and what goes to a group is written short. The bits of a fingerprint are dealt into
classes; a variant's group is the parity of each class. Which bits a variant flips then says how its group
differs from the fingerprint's own: not at all, in one class, or in two. So a fingerprint goes once to each such group,
with the difference, and the receiver flips the bits of those classes itself: it has just those variants that belong
there, whole. With 2 ** t groups that is 1 + t + t (t - 1) / 2 entries for the 2081 variants, whatever the input:
under half a byte a variant at 2 ** 14 groups. The number of groups follows the input, so that one holds about GROUP
variants; entries of a block of fingerprints for one group travel as one row.

All fingerprints that have one variant are within the radius of each other, so each is linked to the least of
them only, and a group gives a spanning forest of its links: no pairs within a group of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmap.llm.common import fresh, materialize
from stallmap.llm.graph import components

SEED = 42
BLOCK = 1 << 14
GROUP = 4_000_000
MOST_CLASSES = 24
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _hash64(shingle: bytes) -> bytes:
    return xxhash.xxh64_intdigest(shingle, SEED).to_bytes(8, "little")


def _hash256(shingle: bytes) -> bytes:
    return xxhash.xxh3_128_digest(shingle) + xxhash.xxh3_128_digest(shingle, SEED)


def _shingles(data: bytes, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """A text's words, one space apart, and where its shingles start and end. Fewer words than a shingle: the whole
    sequence is the one shingle. No word: no shingle."""
    found = data.translate(_LOWER).split()
    if not found:
        return b"", [], []
    line, n = b" ".join(found), max(1, len(found) - shingle + 1)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    return line, starts, [*gaps[shingle - 1 :].tolist(), len(line)] if len(found) > shingle else [len(line)]


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """The hashes of the different shingles of a text in UTF-8, in order."""
    line, starts, ends = _shingles(data, shingle)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets in order; that of two empty ones is 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def signature(data: bytes, shingle: int, words: int = 1) -> bytes:
    """SimHash of the word shingles of a text in UTF-8: one big-endian word of 64 bits, or four. A bit is 1 if
    it is set in over half of the shingles' hashes (for one word, their XXH64). Fewer words of text than a
    shingle: the whole sequence is the one shingle. No word: all bits are 0."""
    return _signed(data, shingle, words)[0]


def _signed(data: bytes, shingle: int, words: int) -> tuple[bytes, np.ndarray]:
    """signature(), and the first 64 bits of the hashes of all shingles."""
    line, starts, ends = _shingles(data, shingle)
    if not starts:
        return bytes(8 * words), np.zeros(0, np.uint64)
    n, of, firsts = len(starts), _hash64 if words == 1 else _hash256, []
    votes = np.zeros(64 * words, np.int64)
    for k in range(0, n, 1 << 15):
        part = b"".join([of(line[s:e]) for s, e in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)])])
        hashes = np.frombuffer(part, np.uint8).reshape(-1, 8 * words)
        votes += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        firsts.append(hashes.view(np.uint64)[:, 0])
    return np.packbits(2 * votes > n, bitorder="little").view("<u8").astype(">u8").tobytes(), np.concatenate(firsts)


def signatures(docs: DataFrame, text_col: str, out: str, shingle: int, words: int = 1) -> DataFrame:
    """docs with one more column `out`, binary. Null text: as an empty one."""
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(at).cast(pa.large_binary()).to_pylist()
            found = pa.array([signature(x or b"", shingle, words) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, out])

    return docs.mapInArrow(batches, docs.withColumn(out, F.lit(b"")).schema)


class Classes:
    """The classes of a fingerprint's bits, and the variants by the classes that they flip."""

    def __init__(self, width: int, half: int, n: int):
        self.t = n
        # What a group differs in, and the masks of the variants that differ so.
        by: dict[int, list[int]] = {}
        for k in range(half + 1):
            for bits in combinations(range(width), k):
                delta = 0
                for i in bits:
                    delta ^= 1 << (i % n) if n else 0
                by.setdefault(delta, []).append(sum(1 << i for i in bits))
        self.deltas = np.array(sorted(by), np.uint32)
        self.masks = [np.array(by[d], np.uint64) for d in sorted(by)]
        self.bits = [np.uint64(sum(1 << i for i in range(c, width, n))) for c in range(n)]

    @classmethod
    def sized(cls, variants: int, width: int, half: int, group: int | None = None) -> Classes:
        return cls(width, half, min(MOST_CLASSES, max(0, math.ceil(math.log2(max(1, variants / (group or GROUP)))))))

    def parity(self, fps: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fps), np.uint32)
        for c, mask in enumerate(self.bits):
            out |= (np.bitwise_count(fps & mask) & np.uint8(1)).astype(np.uint32) << np.uint32(c)
        return out

    def entries(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each group that a fingerprint goes to: the group, the fingerprint's place, the number of the difference; by group."""
        groups = (self.parity(fps)[:, None] ^ self.deltas[None, :]).reshape(-1)
        order = np.argsort(groups, kind="stable")
        return groups[order], order // len(self.deltas), (order % len(self.deltas)).astype(np.uint16)

    def variants(self, fps: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The variants of fingerprints that came with these differences, and whose each is."""
        found, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for d in np.unique(which).tolist():
            at = np.flatnonzero(which == d)
            found.append((fps[at][:, None] ^ self.masks[d][None, :]).reshape(-1))
            whose.append(np.repeat(at, len(self.masks[d])))
        return np.concatenate(found), np.concatenate(whose)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the edges a-b: each node and the least one that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    inner = label != np.arange(len(nodes))
    return nodes[label[inner]], nodes[inner]


def _packed(sigs: DataFrame, classes: Classes, words: int, fields) -> DataFrame:
    """sigs (node, sig) -> grp, entries: for each group of each word, what a block of nodes sends to it. fields(nodes, bits):
    the fingerprints (nodes x words), and the columns that go with each entry."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names = b.column(0).to_numpy().view(np.uint64)
            bits = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(len(names), -1)
            for start in range(0, len(names), BLOCK):
                part = slice(start, start + BLOCK)
                fps, columns = fields(names[part], bits[part])
                rows = []
                for word in range(words):
                    groups, at, which = classes.entries(fps[:, word])
                    cuts = np.flatnonzero(np.diff(groups, prepend=np.uint32(0xFFFFFFFF))) if len(groups) else []
                    for s, e in zip(cuts, [*cuts[1:], len(groups)]):
                        own = at[s:e]
                        data = b"".join([which[s:e].tobytes(), *[np.ascontiguousarray((c[:, word] if c.ndim > 1 else c)[own]).tobytes() for c in columns]])
                        rows.append((word << classes.t | int(groups[s]), data))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["grp", "entries"])

    tasks = max(1, math.ceil(sigs.count() / BLOCK))
    return sigs.select("node", "sig").repartition(tasks).mapInArrow(batches, "grp long, entries binary")


def _unpacked(entries: list[bytes], kinds: list) -> list[np.ndarray]:
    size = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list] = [[] for _ in kinds]
    for data in entries:
        n, at = len(data) // size, 0
        for own, k in zip(parts, kinds):
            own.append(np.frombuffer(data, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) for x in parts]


def _meetings(variants: np.ndarray, order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the variants that come more than once, by variant and order_by, and for each the place in this list where
    its variant begins."""
    order = np.argsort(variants)
    ranked = variants[order]
    same = ranked[1:] == ranked[:-1]
    at = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) > 1 else order[:0]
    at = at[np.lexsort((order_by[at], variants[at]))]
    first = np.insert(variants[at][1:] != variants[at][:-1], 0, True)[: len(at)]
    return at, np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else at


def ball_links(sigs: DataFrame, radius: int, width: int = 64) -> DataFrame:
    """sigs: node (distinct longs: the fingerprints themselves), sig (the same, binary), materialised -> a, b: links of nodes
    at most radius bits apart that connect whatever all such links connect."""
    half = (radius + 1) // 2
    classes = Classes.sized(sigs.count() * sum(math.comb(width, k) for k in range(half + 1)), width, half)
    packed = _packed(sigs, classes, 1, lambda names, bits: (bits, [names]))

    def meet(rows: pa.Table) -> pa.Table:
        which, fps = _unpacked(rows["entries"].to_pylist(), [np.uint16, np.uint64])
        variants, whose = classes.variants(fps, which)
        at, begin = _meetings(variants, fps[whose].view(np.int64))
        name = fps[whose[at]]
        near = np.bitwise_count(name ^ name[begin]) <= radius
        a, b = spanning(name[begin][near], name[near])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return packed.groupBy("grp").applyInArrow(meet, "a long, b long")


def _node(sig: str) -> Column:
    """Eight bytes, big-endian, as a long."""
    halves = [F.conv(F.substring(F.hex(sig), at, 8), 16, 10).cast("long") for at in (1, 9)]
    return F.shiftleft(halves[0], 32).bitwiseOR(halves[1])


def link(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id: the least doc_id
    of the documents that links reach from it.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other.
    Repeated rows are copies of each other. Null ids keep their rows; a class of null ids only has a null id.
    Very long texts are read whole. An empty table gives no rows. Other columns of docs are not looked at.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    slim = materialize(signatures(slim, "text", "sig", shingle).select("doc_id", "sig"), "simhash-docs")
    own = materialize(slim.groupBy("sig").agg(F.min("doc_id").alias("least")).withColumn("node", _node("sig")), "simhash-nodes")
    roots = components(ball_links(own, radius))
    own = own.withColumnRenamed("node", "n")
    rooted = materialize(own.join(roots, own.n == roots.node, "left").select("sig", "least", F.coalesce("root", "n").alias("root")), "simhash-rooted")
    names = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    classes = materialize(rooted.join(names, "root").select("sig", "component_id"), "simhash-classes")
    return slim.join(classes, "sig").select("doc_id", F.lower(F.hex("sig")).alias("fingerprint"), "component_id")


#: Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more. Such texts
#: differ in up to 15 of 100 bits, 10 in 64: more than a ball can reach. So their signature has 64 * SIG_WORDS bits, of which
#: WORDS choices of WIDTH are fingerprints; texts whose balls meet in any of them are candidates unless more than LIMIT of
#: 56 bits differ (9 on average at a similarity of 0.8, with a deviation of 3) or the numbers of their shingles rule a
#: similarity of SIMILAR out, and the shingles themselves decide. Of pairs at just 0.8 that finds 93 in 100, of pairs at
#: 0.85 98, by simulation of independent bits.
SIG_WORDS, WORDS, WIDTH, RADIUS, LIMIT, SIMILAR = 4, 32, 32, 2, 20, 0.8
#: Members of a variant up to which all their pairs are looked at where they meet. Of larger ones each member first gets the
#: nearest of WINDOW others; the rest are looked at once it is known which belong together, about PIECE texts in a group.
FEW, WINDOW, PIECE = 16, 16, 1 << 14
#: Candidates of a text in a group up to which all of them are rows; pairs that are held against each other at once; single texts
#: that a text asks one by one.
PAIRS, AT_ONCE, ASKED = 3, 1 << 20, 64
#: How many of a text's nearest candidates are verified in a round, before all that still are apart.
NEAREST = (1, 16)
#: Bits of the whole signature in which texts of a similarity of 0.8 differ at most: 38 of 256 on average, with a deviation of 6.
WHOLE_LIMIT = 60
#: Members up to which a component is met text by text; of larger ones all members of a PART at once.
SINGLE, PART = 4, 512
#: Steps of the number of shingles in which two texts of a similarity of SIMILAR differ at most, and a distance that is too far.
SIZE_STEPS, FAR = 4, 255


def choices(words: int = WORDS, width: int = WIDTH, bits: int = 64 * SIG_WORDS) -> np.ndarray:
    """The bits of each fingerprint: all bits in an order set by hashes, over and over."""
    order = [i for k in range(-(-words * width // bits)) for i in sorted(range(bits), key=lambda i: xxhash.xxh64_intdigest(f"{k} {i}".encode()))]
    return np.array(order[: words * width]).reshape(words, width)


def chosen_bits(sig: np.ndarray, which: np.ndarray) -> np.ndarray:
    """sig (rows x 64-bit words) -> the fingerprints, rows x choices."""
    bits = np.unpackbits(np.ascontiguousarray(sig).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    out = np.zeros((len(sig), len(which)), np.uint64)
    for w, own in enumerate(which):
        out[:, w] = np.ascontiguousarray(np.packbits(bits[:, own], axis=1, bitorder="little")).view("<u4")[:, 0]
    return out


def _size_step(n: int) -> int:
    """The number of shingles on a scale of 8 bits whose SIZE_STEPS steps are a factor of 1 / SIMILAR."""
    return min(255, int(SIZE_STEPS * math.log(max(1, n)) / -math.log(SIMILAR)))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the 56 bits of checks differ; FAR if more than LIMIT, or if the numbers of shingles differ too much."""
    bits = np.bitwise_count((x ^ y) >> np.uint64(8))
    steps = np.abs((x & np.uint64(255)).astype(np.int16) - (y & np.uint64(255)).astype(np.int16))
    return np.where((bits <= LIMIT) & (steps <= SIZE_STEPS), bits, FAR).astype(np.int16)


def _pairs(name: np.ndarray, check: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of variants (where each begins, and how many it has) -> pairs that aren't far, and their distances: all
    those of variants with FEW members at most; of others each member, once, with the nearest of the least one and the WINDOW
    before it in any of them."""
    here, a, b, away = np.arange(len(name)), [], [], []

    def put(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> None:
        near = d < FAR
        a.append(name[x[near]])
        b.append(name[y[near]])
        away.append(d[near])

    small, large = np.flatnonzero(size <= FEW), np.flatnonzero(size > FEW)
    for k in range(1, FEW):
        small = small[here[small] - begin[small] >= k]
        if not len(small):
            break
        put(small - k, small, _distance(check[small - k], check[small]))
    best, partner = np.full(len(large), FAR, np.int16), large.copy()
    for k in range(WINDOW + 1):
        other = large - k if k else begin[large]
        own = np.flatnonzero((other >= begin[large]) & (other < large))
        d = _distance(check[other[own]], check[large[own]])
        better = d < best[own]
        best[own[better]], partner[own[better]] = d[better], other[own[better]]
    # A member of a family is in most of its variants with the same others.
    order = np.lexsort((best, name[large]))
    order = order[np.insert(np.diff(name[large][order]) != 0, 0, True)[: len(order)]]
    put(partner[order], large[order], best[order])
    a, b, away = np.concatenate(a), np.concatenate(b), np.concatenate(away)
    # The same two may meet in many variants.
    both, first = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True) if len(a) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    return both[0], both[1], away[first]


def _width() -> tuple[int, int]:
    """Half the radius of the choices' balls, and the number of variants in one."""
    half = (RADIUS + 1) // 2
    return half, sum(math.comb(WIDTH, k) for k in range(half + 1))


def _with_words(*numbers: str) -> Column:
    """sig, and numbers as further words of 64 bits."""
    return F.concat("sig", *[F.unhex(F.lpad(F.hex(n), 16, "0")) for n in numbers]).alias("sig")


def _thinned(a: np.ndarray, b: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs a group puts out, and the texts whose others it doesn't: all pairs of texts with PAIRS at most, and the nearest
    one of any text. What is left out is between two texts of the second kind."""
    if not len(a):
        return np.zeros(0, bool), a
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    busy = np.bincount(at, minlength=len(names)) > PAIRS
    keep = ~(busy[x] & busy[y])
    order = np.lexsort((np.tile(away, 2), at))
    keep[order[np.insert(np.diff(at[order]) != 0, 0, True)] % len(a)] = True
    return keep, names[busy]


def meetings(sigs: DataFrame) -> DataFrame:
    """sigs: node (distinct longs), sig (binary of SIG_WORDS 64-bit words), size (its _size_step), materialised -> a, b, away:
    candidates and their distances. Rows with a null distance name, as a and b, a text of variants of more than FEW or with more than PAIRS
    candidates: a row for each group that it comes to, none for a variant. Candidates that aren't rows are between two such texts, and
    crossing() finds them again. A check is the first 56 bits of the signature and the size."""
    half, ball = _width()
    classes = Classes.sized(sigs.count() * ball, WIDTH, half)
    which_bits = choices()

    def fields(names: np.ndarray, bits: np.ndarray) -> tuple:
        fps = chosen_bits(bits[:, :SIG_WORDS], which_bits)
        return fps, [names, bits[:, 0] >> np.uint64(8) << np.uint64(8) | bits[:, SIG_WORDS], fps.astype(np.uint32)]

    packed = _packed(sigs.select("node", _with_words("size")), classes, WORDS, fields)

    def meet(rows: pa.Table) -> pa.Table:
        which, name, check, fps = _unpacked(rows["entries"].to_pylist(), [np.uint16, np.int64, np.uint64, np.uint32])
        variants, whose = classes.variants(fps.astype(np.uint64), which)
        at, begin = _meetings(variants, name[whose])
        size = np.bincount(begin, minlength=len(at))[begin] if len(at) else begin
        own = whose[at]
        a, b, away = _pairs(name[own], check[own], begin, size)
        keep, busy = _thinned(a, b, away)
        a, b, away = a[keep], b[keep], away[keep]
        crowd = np.unique(np.concatenate([name[own[size > FEW]], busy]))
        away = pa.chunked_array([pa.array(away, pa.int16()), pa.nulls(len(crowd), pa.int16())])
        return pa.table({"a": np.concatenate([a, crowd]), "b": np.concatenate([b, crowd]), "away": away})

    return packed.groupBy("grp").applyInArrow(meet, "a long, b long, away short")


def _different(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns without repeated rows."""
    order = np.lexsort(columns)
    columns = tuple(c[order] for c in columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return tuple(c[new] for c in columns)


def crossing(crowd: DataFrame) -> DataFrame:
    """crowd (node, sig, size: the texts that meetings() names, root, members: the component and how many that has), materialised -> node,
    root: those that come near a text of another component, and that component, as in asking(). The texts meet anew by their
    variants, within a task. In small variants all pairs are looked at; in large ones each component but the largest is held against the
    rest, once for variants of the same texts. Groups of far more texts than PIECE are dealt into pieces, and each two
    pieces meet in a task of their own."""
    half, ball = _width()
    classes = Classes.sized(crowd.count() * ball, WIDTH, half, PIECE * ball)
    which_bits, kind = choices(), f"V{8 * (SIG_WORDS + 3)}"

    def fields(names: np.ndarray, bits: np.ndarray) -> tuple:
        return chosen_bits(bits[:, :SIG_WORDS], which_bits), [names, np.ascontiguousarray(bits).view(kind)[:, 0]]

    # Not stored: readers of Parquet take thousands of rows at once, and these are long.
    packed = _packed(crowd.select("node", _with_words("size", "root", "members")), classes, WORDS, fields)
    entry = 2 + 8 + np.dtype(kind).itemsize
    most = 2 * PIECE * len(classes.deltas) * entry  # twice what a group has on average
    pieces = materialize(packed.groupBy("grp").agg(F.ceil(F.sum(F.length("entries")) / most).cast("int").alias("pieces")), "simhash-pieces")
    dealt = packed.join(F.broadcast(pieces), "grp").withColumn("own", F.pmod(F.xxhash64("entries"), F.col("pieces")).cast("int"))
    spread = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    spread = spread.select("grp", "entries", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def meet(rows: pa.Table) -> pa.Table:
        entries = rows["entries"].to_pylist()
        own = np.repeat(rows["own"].to_numpy(), [len(x) // entry for x in entries])
        one = rows["i"][0].as_py() == rows["j"][0].as_py()
        which, name, bits = _unpacked(entries, [np.uint16, np.int64, kind])
        bits = bits.view(np.uint64).reshape(len(name), -1)
        sig, check = bits[:, :SIG_WORDS], bits[:, 0] >> np.uint64(8) << np.uint64(8) | bits[:, SIG_WORDS]
        root, members = bits[:, SIG_WORDS + 1].astype(np.int64), bits[:, SIG_WORDS + 2].astype(np.int64)
        word = rows["grp"][0].as_py() >> classes.t
        variants, whose = classes.variants(chosen_bits(sig, which_bits[word : word + 1])[:, 0], which)
        at, begin = _meetings(variants, whose)
        who, here = whose[at], np.arange(len(at))
        size = np.bincount(begin, minlength=len(at))[begin] if len(at) else begin
        node, target, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            found = (root[a] != root[b]) & (_distance(check[a], check[b]) < FAR)
            return found if one else found & (own[a] != own[b])  # those of one piece meet in another task

        def put(a: np.ndarray, b: np.ndarray) -> None:
            less = (members[a] < members[b]) | (members[a] == members[b]) & (root[a] < root[b])
            found = _different(np.where(less, name[a], name[b]), np.where(less, root[b], root[a]))
            node.append(found[0])
            target.append(found[1])
            if len(node) > 256:
                node[:], target[:] = ([x] for x in _different(np.concatenate(node), np.concatenate(target)))

        small = np.flatnonzero(size <= FEW)
        for k in range(1, FEW):
            small = small[here[small] - begin[small] >= k]
            for start in range(0, len(small), AT_ONCE):
                x = small[start : start + AT_ONCE]
                a, b = who[x - k], who[x]
                found = near(a, b)
                put(a[found], b[found])
        for s in np.flatnonzero((begin == here) & (size > FEW)).tolist():
            m = who[s : s + size[s]]
            key = xxhash.xxh3_128_digest(m.tobytes())
            roots, n = np.unique(root[m], return_counts=True)
            if len(roots) == 1 or key in seen:
                continue
            seen.add(key)
            left = m[root[m] != roots[np.argmax(n)]]
            step = max(1, AT_ONCE // len(m))
            for k in range(0, len(left), step):
                x = left[k : k + step]
                a, b = np.nonzero(near(x[:, None], m[None, :]))
                a, b = x[a], m[b]
                found = np.bitwise_count(sig[a] ^ sig[b]).sum(axis=1, dtype=np.int64) <= WHOLE_LIMIT
                put(a[found], b[found])
        node, target = _different(np.concatenate(node), np.concatenate(target))
        return pa.table({"node": node, "root": target})

    return spread.groupBy("grp", "i", "j").applyInArrow(meet, "node long, root long")


def asking(pairs: DataFrame, crowd: DataFrame, sigs: DataFrame, sized: DataFrame) -> DataFrame:
    """pairs (a, b), crowd (node: the texts that meetings() names), sigs (node, sig, size), sized (node, root, size: its component and how many
    that has) -> node, root: the components that a text may belong to, as it comes near one of their texts. Of two components the texts of the
    smaller one ask. So a text near many of a large component asks once."""
    of = lambda x: sized.select(F.col("node").alias(x), F.struct(F.col("size"), F.col("root")).alias(f"of_{x}"))
    alone = lambda x: F.coalesce(f"of_{x}", F.struct(F.lit(1).cast("long").alias("size"), F.col(x).alias("root")))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", alone("a").alias("of_a"), alone("b").alias("of_b")).where("of_a.root != of_b.root")
    less = F.col("of_a") < F.col("of_b")
    own = both.select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(less, F.col("of_b.root")).otherwise(F.col("of_a.root")).alias("root")).distinct()
    rooted = sigs.join(crowd, "node", "left_semi").join(of("node"), "node", "left").select("node", "sig", "size", alone("node").alias("of"))
    rooted = materialize(rooted.select("node", "sig", "size", "of.root", F.col("of.size").alias("members")), "simhash-crowd")
    return own if rooted.isEmpty() else own.unionByName(crossing(rooted)).distinct()


def _alike(texts: list[np.ndarray], members: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each of the texts its similarity to all members, over an index of the members' shingles, so that a text is compared with all
    of them at once."""
    sizes = np.array([len(m) for m in members])
    shingles, owner = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    for x in texts:
        first = np.searchsorted(shingles, x, side="left")
        n = np.searchsorted(shingles, x, side="right") - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(members))
        yield both / np.maximum(len(x) + sizes - both, 1)


def _closest(texts: list[np.ndarray], members: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """For each of the texts that is similar enough to a member: its place, and that of the most similar one."""
    for k, alike in enumerate(_alike(texts, members)):
        best = int(np.argmax(alike))
        if alike[best] >= SIMILAR:
            yield k, best


def joined(asks: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """asks (node, root), members (root, node), sets (n, shingles) -> a, b: each asking text with the most similar member of each part of the
    component that it asks, if that is similar enough. Members and askers of a component are dealt into parts, and each part of the
    members meets each of the askers in a task of its own: there is a row for a text and part, none for a pair."""
    count = lambda rows, n: rows.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("int").alias(n))
    grid = count(members, "m_parts").join(count(asks, "a_parts"), "root")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = members.join(grid, "root").select("root", "node", F.lit(False).alias("asks"), place("m_parts").alias("m"), each("a_parts").alias("a"))
    other = asks.join(grid, "root").select("root", "node", F.lit(True).alias("asks"), each("m_parts").alias("m"), place("a_parts").alias("a"))

    def meet(rows: pa.Table) -> pa.Table:
        name, asks = rows["node"].to_numpy(), rows["asks"].to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        pairs = list(_closest([found[k] for k in left], [found[k] for k in right])) if len(left) and len(right) else []
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        return pa.table({"a": name[left[a]], "b": name[right[b]]})

    return own.unionByName(other).join(sets.withColumnRenamed("n", "node"), "node").groupBy("root", "m", "a").applyInArrow(meet, "a long, b long")


def families(few: DataFrame) -> DataFrame:
    """few (a, b): texts that ask single ones -> node, family: those of the asks of texts with over ASKED of them, by component. The others are in
    proportion to the texts."""
    ends = few.select(F.col("a").alias("node")).unionByName(few.select(F.col("b").alias("node")))
    busy = materialize(ends.groupBy("node").count().where(F.col("count") > ASKED).select("node"), "simhash-busy")
    if busy.isEmpty():
        return busy.select("node", F.col("node").alias("family"))
    of = lambda x: few.join(busy.withColumnRenamed("node", x), x, "left_semi").select("a", "b")
    return components(of("a").unionByName(of("b"))).withColumnRenamed("root", "family")


def within(kin: DataFrame, sets: DataFrame) -> DataFrame:
    """kin (node, family), sets (n, shingles) -> a, b: links that connect whatever the pairs of a family that are similar enough connect. A family
    is dealt into parts, and each two parts meet in a task of their own: there is a row for a text and part, none for a pair."""
    grid = kin.groupBy("family").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = kin.join(grid, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    spread = spread.select("family", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def meet(rows: pa.Table) -> pa.Table:
        name, own = rows["node"].to_numpy(), rows["own"].to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        left, right = np.flatnonzero(own == rows["i"][0].as_py()), np.flatnonzero(own == rows["j"][0].as_py())
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            for k, alike in zip(left.tolist(), _alike([found[k] for k in left], [found[k] for k in right])):
                near = right[alike >= SIMILAR]
                a.append(np.full(len(near), name[k]))
                b.append(name[near])
        a, b = spanning(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": a, "b": b})

    return spread.join(sets.withColumnRenamed("n", "node"), "node").groupBy("family", "i", "j").applyInArrow(meet, "a long, b long")


def _named(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (id, text, k1, k2) -> id, k1, k2, sig, same: binary, alike for equal sets of shingles, size: their _size_step."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [x or b"" for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            both = [_signed(x, shingle, SIG_WORDS) for x in texts]
            sig = pa.array([x for x, _ in both], pa.binary())
            sets = [np.unique(x) for _, x in both]
            same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            size = pa.array([_size_step(len(x)) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), sig, same, size], names=["id", "k1", "k2", "sig", "same", "size"])

    return docs.mapInArrow(batches, f"id {dict(docs.dtypes)['id']}, k1 long, k2 int, sig binary, same binary, size long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (n, text) -> n, its shingle_set as binary."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [shingle_set(x or b"", shingle).tobytes() for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["n", "shingles"])

    return texts.mapInArrow(batches, "n long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            both = zip(*(b.column(c).cast(pa.large_binary()).to_pylist() for c in (2, 3)))
            near = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILAR for x, y in both]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    left, right = (sets.select(F.col("n").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(batches, "a long, b long")


def _nearest(pairs: DataFrame, most: int) -> DataFrame:
    """Of pairs (a, b, away) so many of the nearest ones of each end."""
    place = lambda x, y: F.row_number().over(Window.partitionBy(x).orderBy("away", y)) <= most
    of = lambda x, y: pairs.withColumn("chosen", place(x, y)).where("chosen").select("a", "b")
    return of("a", "b").unionByName(of("b", "a")).distinct()


def similar(met: DataFrame, sigs: DataFrame, sets_of) -> DataFrame:
    """met: meetings(), materialised; sigs: its input -> node, root: components of the candidates that are similar enough. A round each
    verifies NEAREST pairs of each node. What then still is apart is settled between texts and components: a text asks each component
    near which it comes, and is held against all its members, so that neither a large group of near copies nor what lies just outside it makes pairs.
    Single texts that ask many others are held against their whole family.
    sets_of(pairs): node's sets of shingles (n, shingles)."""
    pairs, crowd = materialize(met.where("away is not null").distinct(), "simhash-pairs"), met.where("away is null").select(F.col("a").alias("node"))

    def verified(chosen: DataFrame) -> DataFrame:
        chosen = materialize(chosen, "simhash-chosen")
        return materialize(_verified(chosen, sets_of(chosen)), "simhash-links")

    def apart(roots: DataFrame) -> DataFrame:
        of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "away")

    links = verified(_nearest(pairs, NEAREST[0]))
    for most in NEAREST[1:]:
        links = links.unionByName(verified(_nearest(apart(components(links)), most)))
    roots = components(links)
    sized = materialize(roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root").select("node", "root", "size"), "simhash-sized")
    asks = materialize(asking(pairs.select("a", "b"), crowd, sigs, sized), "simhash-asks")
    # Components that aren't in `sized` are single texts.
    few = asks.join(sized.where(F.col("size") > SINGLE).select("root").distinct(), "root", "left_anti")
    few = few.join(sized.select(F.col("node").alias("b"), "root"), "root", "left").select(F.col("node").alias("a"), F.coalesce("b", "root").alias("b"))
    few = materialize(few, "simhash-few")
    kin = materialize(families(few), "simhash-kin")
    if not kin.isEmpty():
        links = links.unionByName(materialize(within(kin, sets_of(kin.select(F.col("node").alias("a"), F.col("node").alias("b")))), "simhash-links"))
        of = lambda x: kin.select(F.col("node").alias(x), F.col("family").alias(f"of_{x}"))
        few = few.join(of("a"), "a", "left").join(of("b"), "b", "left").where("not coalesce(of_a = of_b, false)").select("a", "b")
    links = links.unionByName(verified(few))
    many = sized.where(F.col("size") > SINGLE).join(asks.select("root").distinct(), "root", "left_semi")
    own = materialize(asks.join(many.select("root").distinct(), "root", "left_semi"), "simhash-askers")
    if not own.isEmpty():
        members = materialize(many.select("root", "node"), "simhash-members")
        ends = own.select(F.col("node").alias("a"), F.col("node").alias("b")).unionByName(members.select(F.col("node").alias("a"), F.col("node").alias("b")))
        links = links.unionByName(materialize(joined(own, members, sets_of(ends)), "simhash-links"))
    return components(links)


def deduplicated(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one of each group of near-duplicates, with just their columns: the least id, null
    ids last, then the least hash of the text. Groups are what pairs of a similarity of SIMILAR or more reach, of
    those pairs that become candidates; texts with equal sets of shingles always do. Very long texts are read whole,
    some thousand shingles at a time. Texts without words are copies of
    each other. Of repeated rows one stays. An empty table gives no rows."""
    k1, k2 = fresh(docs, "simhash_k1"), fresh(docs, "simhash_k2")
    keyed = docs.withColumn(k1, F.xxhash64(id_col, text_col)).withColumn(k2, F.hash(text_col, id_col))
    slim = keyed.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(k1).alias("k1"), F.col(k2).alias("k2"))
    texts = slim
    slim = materialize(_named(slim, shingle), "simhash-docs")
    order = F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("k1"), F.col("k2"))
    own = slim.groupBy("same").agg(F.min(order).alias("least"), F.min("sig").alias("sig"), F.min("size").alias("size"))
    own = materialize(own.withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    met = materialize(meetings(own), "simhash-met")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Of the texts that are in a pair, once each."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        ends = own.join(ends, "node", "left_semi").select(F.col("node").alias("n"), F.col("least.k1").alias("k1"), F.col("least.k2").alias("k2"))
        return materialize(_sets(texts.join(ends, ["k1", "k2"]).select("n", "text").dropDuplicates(["n"]), shingle), "simhash-sets")

    roots = similar(met, own.select("node", "sig", "size"), sets_of)
    own = own.select(F.col("node").alias("n"), "least")
    rooted = own.join(roots, own.n == roots.node, "left").groupBy(F.coalesce("root", "n").alias("root")).agg(F.min("least").alias("least"))
    winners = materialize(rooted.select(F.col("least.k1").alias(k1), F.col("least.k2").alias(k2)), "simhash-winners")
    # The keys of the semi join are those of the distinct, which so needs no exchange of its own.
    return keyed.join(winners, [k1, k2], "left_semi").dropDuplicates([k1, k2]).drop(k1, k2)
