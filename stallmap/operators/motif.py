"""Motifs: candidates at every 3' end, ownership of G tracts, flanks, genomic places, clusters, choice for a site."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmap.constants import FLANK, MOTIF_CLASSES, MOTIF_KINDS, MOTIF_MIN, THREE_PRIME_ZONE
from stallmap.functions.intervals import overlap_join, pieces, pieces_as_text, union
from stallmap.functions.joins import dealt
from stallmap.storage import discard, materialize

_G, _LOOP_LETTERS, _BETWEEN = ord("G"), b"ATCGN", b"#"
#: Bases that are looked at together, and how many of them are looked at again as those before the next ones.
PART, BEFORE = 1 << 16, 64


def _after_loop(x: np.ndarray, low: int, high: int, letters: np.ndarray | None) -> np.ndarray:
    """x: for each place the length of the longest part of a motif that ends there, or 0 -> the same with a loop after it.
    letters: how many loop letters stand right before each place; None if all are."""
    out, some, longer = np.zeros(len(x), np.uint8), (x > 0).view(np.uint8), x.copy()
    for k in range(1, high + 1):
        longer += some
        if k >= low:
            np.maximum(out[k:], longer[:-k] if letters is None else longer[:-k] * (letters[k:] >= k), out=out[k:])
    return out


def _after_tract(x: np.ndarray | None, g: np.ndarray, other: np.ndarray, n: int, bulge: int) -> np.ndarray:
    """The same with a tract after it, or for the first tract if x is None. g, other: by base, 1 if it is a G, or one that may
    bulge."""
    out = np.zeros(len(g) + 1, np.uint8)
    some = None if x is None else (x > 0).view(np.uint8)

    def ends(parts: list[tuple[np.ndarray, int]]) -> None:
        length = sum(m for _, m in parts)
        size, at = len(g) - length + 1, 0
        if size <= 0:
            return
        fits = np.ones(size, np.uint8)
        for mask, m in parts:
            for _ in range(m):
                fits &= mask[at : at + size]
                at += 1
        fits *= np.uint8(length) if x is None else x[:size] + some[:size] * np.uint8(length)
        np.maximum(out[length:], fits, out=out[length:])

    if not bulge:
        ends([(g, n)])
    for b in range(1, bulge + 1):
        for one in (1, n - 1):  # Gs before the bulge
            ends([(g, one), (other, b), (g, n - one)])
    return out


def matches(seq: bytes) -> np.ndarray:
    """A row for each kind of motif: for each place of seq (0 to its length) the length of the longest match of that kind that
    ends there, or 0. Tract by tract and loop by loop, over all places at once; no motif is as long as 255."""
    s = np.frombuffer(seq, np.uint8)
    g = (s == _G).view(np.uint8)
    valid = np.isin(s, np.frombuffer(_LOOP_LETTERS, np.uint8))
    letters = None
    if not valid.all():
        place = np.arange(len(s) + 1)
        letters = place - np.maximum.accumulate(np.where(np.insert(~valid, 0, True), place, 0))
    other = valid.view(np.uint8) & ~g
    known: dict[tuple, np.ndarray] = {}
    out = []
    for _, tracts, loops in MOTIF_KINDS:
        done: tuple = ()
        for tract, loop in zip(tracts, (None, *loops)):
            for step in (loop, tract):
                if step is None:
                    continue
                x, done = known.get(done), (*done, step)
                if done not in known:
                    known[done] = _after_loop(x, *loop, letters) if step is loop else _after_tract(x, g, other, *tract)
        out.append(known[done])
    return np.stack(out)


def found_in(seqs: list[str]) -> list[np.ndarray]:
    """Of each sequence, rows e, start, priority, far of its candidates, by e. The last base of a sequence ends none. Sequences
    stand side by side, with a letter between them that no motif holds, and are looked at some PART bases at a time."""
    data = _BETWEEN.join(x.encode("ascii", "replace") for x in seqs)
    lengths = np.array([len(x) for x in seqs], np.int64)
    begins = np.cumsum(np.concatenate([[0], lengths[:-1] + 1])) if len(seqs) else lengths
    ends, rows = [], [np.zeros((0, 4), np.int64)]
    for at in range(0, len(data), PART):
        first = max(0, at - BEFORE)
        got = matches(data[first : at + PART])[:, at - first + 1 :]
        hit = np.flatnonzero(got.any(axis=0))
        got = got[:, hit]
        e, far, shortest, priority = at + 1 + hit, got.max(axis=0), np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)
        for c in sorted(MOTIF_CLASSES):
            own = got[[k for k, kind in enumerate(MOTIF_KINDS) if kind[0] == c]]
            least = np.where(own > 0, own, 255).min(axis=0)
            new = (priority == 0) & (least < 255)
            shortest[new], priority[new] = least[new], c
        rows.append(np.stack([e, e - shortest, priority, e - far], axis=1))
    rows = np.concatenate(rows)
    of = np.searchsorted(begins, rows[:, 0], side="left") - 1 if len(rows) else np.zeros(0, np.int64)
    rows[:, [0, 1, 3]] -= begins[of, None] if len(rows) else 0
    # Neither the ends that are too near a sequence's start, nor its last base.
    fine = (rows[:, 0] >= MOTIF_MIN) & (rows[:, 0] < lengths[of])
    rows, of = rows[fine], of[fine]
    cuts = np.searchsorted(of, np.arange(len(seqs) + 1))
    return [rows[i:j] for i, j in zip(cuts, cuts[1:])]


def _by_sequence(seqs: DataFrame, id_col: str, schema: str, rows_of: Callable[[str, np.ndarray], list]) -> DataFrame:
    """rows_of(seq, its candidates) -> columns of a table, for each sequence (id, seq), with its id in front."""
    kinds = {"int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]

    def tables(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        held = []
        for id_, seq, found in zip(ids, texts, found_in(texts)):
            if len(found):
                cols = rows_of(seq, found)
                made = [pa.array([id_] * len(cols[0]), pa.string()), *[pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)]]
                held.append(pa.RecordBatch.from_arrays(made, names=["id", *(f for f, _ in fields)]))
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, texts = [], []
            for id_, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(id_)
                texts.append(seq or "")
                if sum(map(len, texts[-64:])) > 16 * PART or len(texts) >= 1024:
                    yield from tables(ids, texts)
                    ids, texts = [], []
            yield from tables(ids, texts)

    return seqs.select(F.col(id_col).cast("string").alias("id"), "seq").mapInArrow(batches, f"id string, {schema}")


_FOUND = "e int, start int, priority int, far int"


def candidates(seqs: DataFrame, id_col: str = "contig") -> DataFrame:
    """id, e, start, priority, far: at each 3' end the best class, the shortest match of that class, and the farthest
    start of any. Where kinds match is worked out for all places of a sequence at once, in Arrow batches."""
    return _by_sequence(seqs, id_col, _FOUND, lambda _, found: list(found.T))


def owners(seq: str, found: np.ndarray) -> np.ndarray:
    """Of the candidates of a sequence (rows of found_in()) those that keep a place.

    By the rule each motif claims its G tract up to one base past its 3' end, from the right end of the sequence on; a better
    class takes a tract over, and with it what lies to the right as far as Gs go; an equal or worse one gets
    nothing. So it is enough to know for each tract three places: its Gs, the base after them, and the base after
    that, which is the next tract's first if that stands one base off. A motif can claim the latter two only if it ends at
    the tract's end, or one base before."""
    data = np.frombuffer(seq.encode("ascii", "replace"), np.uint8)
    n = len(data)
    if not len(found):
        return found
    g = np.concatenate([[False], data == _G, [False]])
    starts, stops = np.flatnonzero(~g[:-1] & g[1:]), np.flatnonzero(g[:-1] & ~g[1:])
    tract = np.searchsorted(starts, found[:, 0] - 1, side="right") - 1
    kept: set[int] = set()
    right_start, right = -1, None  # of the tract to the right: where it starts, and who has its Gs
    right_held: set[int] = set()
    for t in np.unique(tract)[::-1].tolist():
        own = found[tract == t] if len(found) < 64 else found[np.searchsorted(tract, t) : np.searchsorted(tract, t, side="right")]
        stop = int(stops[t])
        near = right_start == stop + 1
        if not near:
            kept |= right_held | ({right} if right else set())
            right, right_held = None, set()
        inside = after = beyond = None  # each (priority, e)
        for e, _, priority, _ in own[::-1].tolist():
            me = (priority, e)
            if inside is not None:
                if inside[0] <= priority:
                    continue
            elif e == stop and near and right is not None and right[0] <= priority:
                continue
            takes_over_after = e == stop - 1 and after is not None
            if e >= stop - 1 and stop < n:
                after = me
            if e == stop and stop + 1 < n:
                if near or data[stop + 1] == _G:
                    right = me
                else:
                    beyond = me
            if takes_over_after and stop + 1 < n and data[stop + 1] == _G:
                right = me
            inside = me
        kept |= right_held | ({right} if right else set())
        right_start, right, right_held = int(starts[t]), inside, {x for x in (after, beyond) if x}
    kept |= right_held | ({right} if right else set())
    return found[np.isin(found[:, 0], [e for _, e in kept])]


def _retained(seq: str, found: np.ndarray) -> list:
    """Columns of retained() for one sequence."""
    rows = owners(seq, found)
    left, right = np.maximum(rows[:, 1] - FLANK, 0), np.minimum(rows[:, 0] + FLANK, len(seq) - 1)
    text = lambda a, b: [seq[i:j] for i, j in zip(a.tolist(), b.tolist())]
    return [*rows.T, left, right, text(left, rows[:, 1]), text(rows[:, 1], rows[:, 0]), text(rows[:, 0], right)]


def retained(seqs: DataFrame, id_col: str = "contig") -> DataFrame:
    """The candidates() that own a place of their sequence, with flank_start, flank_end, and the bases of flank, motif, and
    flank (seq5, motif, seq3). Ownership goes from right to left along a sequence, tract by tract, in the same pass."""
    return _by_sequence(seqs, id_col, f"{_FOUND}, flank_start int, flank_end int, seq5 string, motif string, seq3 string", _retained)


def clusters(found: DataFrame) -> DataFrame:
    """id, cluster (from 1), start, end: stretches covered by the longest candidates."""
    stretches = union(found.select("id", F.col("far").alias("start"), F.col("e").alias("end")), ["id"])
    return stretches.withColumn("cluster", F.row_number().over(Window.partitionBy("id").orderBy("start")))


def placed(motifs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """motifs on transcripts (id, start, e, flank_start, flank_end, ...) with pieces, left and right: where they and their
    flanks lie on the genome, 5' to 3', as arrays of (start, end). transcripts: spliced(), with transcript_id as id."""
    joined = motifs.join(dealt(transcripts), "id")
    at = lambda a, b: pieces(F.col("exons"), F.col(a), F.col(b), F.col("strand"))
    return joined.withColumns({"pieces": at("start", "e"), "left": at("flank_start", "start"), "right": at("e", "flank_end")}).drop("exons")


def deduplicated(motifs: DataFrame) -> DataFrame:
    """placed() motifs of a gene with equal pieces and flanks: one row, with the transcripts that have it. Columns id,
    regions (names), and gene_name are taken if they are there. The bases are the same wherever the places are."""
    keys = ["gene_id", "contig", "strand", "pieces", "left", "right", "priority"]
    same = [c for c in ("gene_name", "seq5", "motif", "seq3") if c in motifs.columns]
    who = F.struct("id", "regions") if "regions" in motifs.columns else F.struct("id")
    return motifs.groupBy(*keys).agg(*[F.min(c).alias(c) for c in same], F.array_sort(F.collect_set(who)).alias("transcripts"))


def rows(motifs: DataFrame) -> DataFrame:
    """deduplicated() motifs as the rows of the motif table: contig, start, end, name, strand, class, sequence, pieces,
    flank_sequence, transcripts, left, right, priority; start and end bound the pieces."""
    name = F.create_map(*[F.lit(x) for kv in MOTIF_CLASSES.items() for x in kv])
    return motifs.select(
        "contig", F.array_min("pieces.start").alias("start"), F.array_max("pieces.end").alias("end"), F.concat_ws("|", "gene_name", "gene_id").alias("name"), "strand",
        name[F.col("priority")].alias("class"), F.col("motif").alias("sequence"), "pieces", F.concat_ws("|", "seq5", "motif", "seq3").alias("flank_sequence"), "transcripts", "left", "right", "priority",
    )


def cluster_places(found: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The clusters of candidates on transcripts (id, far, e) on the genome: gene_id, contig, strand, id, cluster, node (id#cluster),
    pieces. A cluster over a junction has several pieces. transcripts: as in placed(), with gene_id."""
    joined = clusters(found).join(dealt(transcripts), "id")
    node = F.concat("id", F.lit("#"), F.col("cluster").cast("string")).alias("node")
    more = [c for c in ("gene_name", "regions") if c in transcripts.columns]
    return joined.select("gene_id", "contig", "strand", "id", "cluster", node, pieces(F.col("exons"), F.col("start"), F.col("end"), F.col("strand")).alias("pieces"), *more)


LOCUS = ["gene_id", "contig", "strand"]
#: Bases of a bin in which pieces of clusters are looked at together.
CLUSTER_BIN = 256


def alike_clusters(places: DataFrame) -> DataFrame:
    """node, rep: of the nodes of a gene with equal pieces, the least one. Transcripts of a gene mostly have the same clusters."""
    reps = places.groupBy(*LOCUS, "pieces").agg(F.min("node").alias("rep"))
    return places.select(*LOCUS, "pieces", "node").join(dealt(reps), [*LOCUS, "pieces"]).select("node", "rep")


def overlapping_clusters(places: DataFrame, width: int = CLUSTER_BIN) -> DataFrame:
    """places (gene_id, contig, strand, node, and start, end or pieces) -> a, b: different nodes of a gene, a before b, any pieces of
    which overlap. Of nodes with equal pieces only the least one is in pairs (alike_clusters() says whose it is), so that
    the transcripts of a gene don't make all their pairs."""
    if "pieces" not in places.columns:
        places = places.withColumn("pieces", F.array(F.struct("start", "end")))
    own = places.groupBy(*LOCUS, "pieces").agg(F.min("node").alias("node")).select(*LOCUS, "node", F.inline("pieces"))
    other = own.withColumnsRenamed({"node": "r_node", "start": "r_start", "end": "r_end"})
    both = overlap_join(own, other, width, LOCUS).where("node < r_node")
    return both.select(F.col("node").alias("a"), F.col("r_node").alias("b")).distinct()


def cluster_links(places: DataFrame, width: int = CLUSTER_BIN) -> DataFrame:
    """places (gene_id, contig, strand, node, pieces) -> a, b: links that connect just the nodes that overlaps connect, no more than a few for
    each piece. Each node is linked to the least node with that piece, and of different pieces, in each bin of bases, each to the one
    that reaches farthest of those before it, if they overlap. A crowded gene is as many tasks as it has bins."""
    flat = places.select(*LOCUS, "node", F.inline("pieces"))
    same = flat.groupBy(*LOCUS, "start", "end").agg(F.min("node").alias("rep"))
    star = flat.join(dealt(same), [*LOCUS, "start", "end"]).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    cut = same.withColumn("bin", bins).withColumn("low", F.greatest("start", F.col("bin") * width)).withColumn("high", F.least("end", (F.col("bin") + 1) * width))
    order = Window.partitionBy(*LOCUS, "bin").orderBy("low", "high", "rep")
    far = F.max(F.struct("high", "rep")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chain = cut.withColumn("far", far).where(F.col("low") < F.col("far.high")).select(F.col("rep").alias("a"), F.col("far.rep").alias("b"))
    return star.unionByName(chain).where("a != b").distinct()


def cluster_groups(places: DataFrame, roots: DataFrame) -> DataFrame:
    """places (gene_id, contig, strand, node, pieces, and id, regions if known) with roots (node, root) -> a row for each group of clusters that overlap,
    directly or through others: gene_id, contig, start, end, group (from 0 in each gene), strand ("." if not all have one), n, members. Start and
    end bound all pieces, whatever lies between. members: id, regions and pieces of each cluster, by node."""
    member = F.struct("node", *[c for c in ("id", "regions") if c in places.columns], "pieces")
    strand = F.when(F.min("strand") != F.max("strand"), ".").otherwise(F.min("strand"))
    both = places.join(dealt(roots), "node").groupBy("gene_id", "contig", "root")
    bounds = both.agg(F.min(F.array_min("pieces.start")).alias("start"), F.max(F.array_max("pieces.end")).alias("end"), strand.alias("strand"), F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    number = F.row_number().over(Window.partitionBy("gene_id").orderBy("start", "end", "root")) - 1
    return bounds.select("gene_id", "contig", "start", "end", number.alias("group"), "strand", "root", "n", "members")


def component_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable. Labels spread along edges and jump to the label of their label until none
    changes; each round is written out, so that the plan stays short, and the round before is deleted."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    labels = materialize(nodes.select("node", F.col("node").alias("root"), F.col("node").alias("old")), "cc-labels")
    while True:
        near = both.join(dealt(labels), both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        spread = labels.join(dealt(near), labels.node == near.a, "left").select("node", "root", F.least("root", "m").alias("next"))
        jump = spread.select(F.col("node").alias("j"), F.col("next").alias("far"))
        new = spread.join(dealt(jump), F.col("next") == F.col("j"), "left").select("node", F.least("next", "far").alias("root"), F.col("root").alias("old"))
        new = materialize(new, "cc-labels")
        settled = new.where("root != old").isEmpty()
        discard(labels)
        labels = new
        if settled:
            discard(both)
            return labels.select("node", "root")


def zones(motifs: DataFrame) -> DataFrame:
    """motifs (contig, strand, pieces, right, ...) with z_start, z_end: a row for the 3' end of each, and one for the start of
    the flank after it, if it has one. On -, the end is taken from the first piece, as the method does."""
    plus, n = F.col("strand") == "+", THREE_PRIME_ZONE
    last, after = F.when(plus, F.element_at("pieces", -1)).otherwise(F.element_at("pieces", 1)), F.try_element_at("right", F.lit(1))
    end = F.struct(F.when(plus, last["end"] - n).otherwise(last["start"]).alias("z_start"), F.when(plus, last["end"]).otherwise(last["start"] + n).alias("z_end"))
    flank = F.struct(F.when(plus, after["start"]).otherwise(after["end"] - n).alias("z_start"), F.when(plus, after["start"] + n).otherwise(after["end"]).alias("z_end"))
    return motifs.select("*", F.inline(F.filter(F.array(end, flank), lambda z: z["z_end"].isNotNull())))


def near_sites(sites: DataFrame, motifs: DataFrame, width: int = 64) -> DataFrame:
    """sites (contig, strand, start, end) with each motif (with a column motif_id) a 3' zone of which they overlap, once."""
    z = zones(motifs.select("motif_id", "contig", "strand", "pieces", "right")).select("contig", "strand", "motif_id", F.col("z_start").alias("r_start"), F.col("z_end").alias("r_end"))
    pairs = overlap_join(sites, z, width).select("contig", "strand", "start", "end", "motif_id").distinct()
    return pairs.join(dealt(motifs.drop("contig", "strand", "start", "end")), "motif_id")


def contains_site() -> Column:
    """Every position of [start, end) lies in the motif's pieces or in those of the flank after it."""
    inside = lambda p: F.exists(F.concat("pieces", "right"), lambda i: (i["start"] <= p) & (p < i["end"]))
    return F.forall(F.sequence("start", F.col("end") - 1), inside)


def best_class(near: DataFrame, site: list[str]) -> DataFrame:
    """Of each site the motifs of its best class, of those that contain it."""
    return near.where(contains_site()).withColumn("best", F.min("priority").over(Window.partitionBy(*site))).where("priority = best").drop("best")


def best_locus(near: DataFrame, site: list[str]) -> DataFrame:
    """Of each site the motifs of the 3'-most place, by the last of their pieces: on + the farthest end, then the smaller
    start; on - the smallest start, then the larger end; then the first in text order."""
    plus, last = F.col("strand") == "+", F.element_at("pieces", -1)
    order = [F.when(plus, -last["end"]).otherwise(last["start"]), F.when(plus, last["start"]).otherwise(-last["end"])]
    text = pieces_as_text(F.col("contig"), F.col("pieces"), F.col("strand"))
    return near.withColumn("_n", F.rank().over(Window.partitionBy(*site).orderBy(*order, text))).where("_n = 1").drop("_n")


def representative(near: DataFrame, site: list[str], serial: str = "serial") -> DataFrame:
    """Of each site one motif: those whose flank after it overlaps the site come first, then the longer flank, then the
    first serial."""
    meets = F.exists("right", lambda i: (i["start"] < F.col("end")) & (F.col("start") < i["end"]))
    length = F.aggregate("right", F.lit(0), lambda a, i: a + (i["end"] - i["start"]))
    order = Window.partitionBy(*site).orderBy(meets.desc(), length.desc(), F.col(serial))
    return near.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
