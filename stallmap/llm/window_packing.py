"""Best-fit decreasing packing of token ids into windows of one length.

A document is its token ids and one separator. What is longer than a window is first cut into full windows, which are
sequences as they are. What is left of each document goes longest first, each piece into the open window that it fills best; if
none has room, a window is opened. A segment tree over the remaining capacities finds the tightest open window: its
leaf c counts the open windows with room for c more ids, and every inner node those below it.

Rests of documents are dealt by a hash of their row into groups of about GROUP, and each group is packed by itself: that is what a
task holds in memory (GROUP windows of ids at most), and their number grows with the input. The room this leaves is that of the last
windows of each group.

Texts are encoded word by word: none of the tokenizer's steps looks across white space, so the ids of a text are those of its
words, and a worker keeps those of the short words it has met, of two generations of about KNOWN. Words of Latin letters, also with
marks behind them, go to the tokenizer's model at once if probes show that it cuts off marks and makes one and the same of each letter
everywhere. The tests hold all this equal to encoding whole texts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmap.llm.common import materialize

WINDOW = 2048
SEPARATOR = 1
GROUP = 16_384
#: Words whose ids a worker keeps, and the length in bytes from which a word is not kept.
KNOWN, LONG_WORD = 300_000, 48
#: Where letters end that may be looked at one by one, and the marks that may stand behind them.
LATIN, _MARKS = 0x250, ".,;:!?#$%&*"
#: Documents, and about how many bytes of their texts, that are encoded before their ids go on.
AT_ONCE, BYTES_AT_ONCE = 1024, 8 << 20


class Capacities:
    """Segment tree over capacities 0 to most: which open window is the tightest that still has so much room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = self.size + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest open window with room for `least`, taken out, and its capacity. Of equally tight ones the one that got
        this capacity last."""
        count, size, i = self.count, self.size, self.size + least
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until the right neighbour has one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - size
        while i:
            count[i] -= 1
            i >>= 1
        return self.open[capacity].pop(), capacity


def best_fit(sizes: Sequence[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """sizes, longest first, none over a window -> the window of each, and its place there."""
    free, windows, offsets, opened = Capacities(window), [], [], 0
    for s in sizes:
        found = free.take(s)
        if found is None:
            found, opened = (opened, window), opened + 1
        which, room = found
        windows.append(which)
        offsets.append(window - room)
        if room > s:
            free.add(room - s, which)
    return windows, offsets


class Encoder:
    """Ids of texts in UTF-8 as little-endian unsigned 32-bit numbers, by a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.model, self.letters, self.marks = self.tokenizer.model, self._letters(), {"": b""}
        ascii_marks = "".join(m for m in _MARKS if self._parts(f"ab{m}{m}") == ["ab", m + m])
        other = "".join(map(chr, self.letters))
        #: Letters that the model can be given at once, and marks that stand behind them.
        self.plain = re.compile(f"([{re.escape(other)}]+)([{re.escape(ascii_marks)}]{{0,{LONG_WORD}}})") if other and ascii_marks else None

    def _parts(self, text: str) -> list[str] | None:
        """What comes to the model, one by one."""
        text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.tokenizer.pre_tokenizer else None

    def _letters(self) -> dict[int, str]:
        """What comes to the model of a Latin letter within a word, of those letters for which that is one thing. None, if a special
        token is a word of letters. (Letters that are composed of others, as in Hangul, lie beyond LATIN.)"""
        if any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()):
            return {}
        found = {}
        for c in filter(str.isalpha, map(chr, range(LATIN))):
            own = self._parts(c)
            if own and len(own) == 1 and all(self._parts(x.format(c)) == [x.format(own[0])] for x in ("{}z", "z{}", "z{}z", "{0}{0}")):
                found[ord(c)] = own[0]
        return found

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Different words and their ids. They are encoded as one text, whose ids the offsets deal out again."""
        line = b" ".join(words)
        found = self.tokenizer.encode(line.decode(), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words] if line.isascii() else [len(w.decode()) + 1 for w in words])
        cuts = (4 * np.searchsorted([s for s, _ in found.offsets], ends)).tolist()
        ids = np.array(found.ids, "<u4").tobytes()
        return {w: ids[s:e] for w, s, e in zip(words, [0, *cuts], cuts)}

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words that aren't known, and their ids."""
        if not self.plain:
            return self._encoded(words)
        known, marks, tokens, letters, match, rest, own = self.known, self.marks, self.model.tokenize, self.letters, self.plain.fullmatch, [], {}
        for w in words:
            found = match(w.decode())
            if not found:
                rest.append(w)
                continue
            stem, mark = found.groups()
            ids = mark and known.get(stem.encode()) or array("I", [t.id for t in tokens(stem.translate(letters))]).tobytes()
            if mark not in marks:
                marks[mark] = np.array(self.tokenizer.encode(mark, add_special_tokens=False).ids, "<u4").tobytes()
            own[w] = ids + marks[mark]
        if len(marks) > KNOWN:
            self.marks = {"": b""}
        return own | self._encoded(rest) if rest else own

    def _of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of different words."""
        known, before = self.known, self.before
        known[b""] = b""
        found = list(map(known.get, words))
        lost = [k for k, x in enumerate(found) if x is None]
        old = list(map(before.get, [words[k] for k in lost]))
        own = {words[k]: x for k, x in zip(lost, old) if x is not None}
        own.update(self._new([words[k] for k, x in zip(lost, old) if x is None]) if len(own) < len(lost) else ())
        for k in lost:
            found[k] = own[words[k]]
        known.update((w, x) for w, x in own.items() if len(w) < LONG_WORD)
        if len(known) > KNOWN:
            self.known, self.before = {}, known
        return found

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each different word of the texts is looked up once, and its ids are put wherever it stands."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        known = self._of(coded.dictionary.cast(pa.large_binary()).to_pylist())
        taken = pa.array(known, pa.large_binary()).take(coded.indices)
        if not len(taken):
            return [b""] * len(texts)
        _, ends, data = taken.buffers()
        cuts = np.frombuffer(ends, np.int64)[taken.offset + split.offsets.to_numpy()].tolist()
        data = memoryview(data) if data else b""
        return [bytes(data[s:e]) for s, e in zip(cuts, cuts[1:])]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for a worker, which serves many tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: row (of docs), doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens."""
    end = np.array([separator], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step = _encoder(tokenizer), 4 * window
        for whole in it:
            size, at = np.cumsum(pc.fill_null(pc.binary_length(whole.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while at < whole.num_rows:
                most = np.searchsorted(size, (size[at - 1] if at else 0) + BYTES_AT_ONCE, side="right")
                b = whole.slice(at, max(1, min(AT_ONCE, int(most) - at)))
                at += b.num_rows
                texts = [x or b"" for x in b.column(2).cast(pa.large_binary()).to_pylist()]
                of, start, ids, total = [], [], [], []
                for k, found in enumerate(encoder.ids(texts)):
                    found += end
                    for s in range(0, len(found), step):
                        of.append(k)
                        start.append(s // 4)
                        ids.append(found[s : s + step])
                        total.append(len(found) // 4)
                own = pa.array(of, pa.int64())
                cols = [b.column(0).take(own), b.column(1).take(own), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "start", "length", "ids", "doc_tokens"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(batches, f"row long, doc_id {kind}, start long, length long, ids binary, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, separator: int = SEPARATOR, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each row of docs: doc_id, start (its document's ids before it), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens (with the separator), sequence_id, offset (its place there). `tokenizer` is a
    file that each worker can read. No sequence is longer than a window.

    Null and empty texts, and texts that the tokenizer leaves nothing of, are one piece, the separator alone. Very long texts
    are read whole, and are as many windows as they fill, and a rest. Repeated rows and null ids are packed each by itself. Pieces of
    one length go by id, then by row. An empty table gives no rows. Other columns of docs are not looked at.
    """
    cut = materialize(pieces(docs, tokenizer, window, separator, id_col, text_col), "windows-pieces")
    full, rest = cut.where(F.col("length") == window), cut.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
        windows, offsets = best_fit(rows["length"].to_pylist(), window)
        # Even numbers; windows that one document fills have the odd ones.
        own = (rows["grp"].to_numpy().astype(np.int64) << 32 | np.array(windows, np.int64)) * 2
        return rows.select(names[:5]).append_column("sequence_id", pa.array(own)).append_column("offset", pa.array(offsets, pa.int64()))

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = dict(cut.dtypes)["doc_id"]
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    dealt = dealt.groupBy("grp").applyInArrow(packed, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    alone = full.select(*names[:5], (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.unionByName(alone)
