"""Hard negatives, fill-in-the-middle and window packing, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stallmap.llm import fill_middle, hard_negatives, quality_classifier, queries, window_packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


# ---- hard negatives ----


def brute_negatives(rows, every, relabel, classes, positives, negatives):
    ok = []
    for v, e, label in rows:
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            label = (label + 1) % classes if v is not None and v % relabel == 0 else label
            ok.append((v, [math.floor(256.0 * x) for x in e], label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    fit = lambda s: max(min(s, 2**63 - 1), 1 - 2**63)
    out = Counter()
    for i, (v, a, label) in enumerate(ok):
        if v is None or v % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), w, own == label) for j, (w, b, own) in enumerate(ok) if j != i and len(a) == len(b)]
        for p, pid, _ in sorted((x for x in scored if x[2]), key=order)[:positives]:
            kept = sorted((x for x in scored if not x[2] and 50 * p <= 100 * x[0] <= 95 * p), key=order)[:negatives]
            out.update((v, pid, k + 1, n[1], fit(p), fit(n[0])) for k, n in enumerate(kept))
    return out


def mined(df, every, **more):
    return Counter(tuple(r) for r in hard_negatives.mine(df, every=every, **more).collect())


def embedded(spark, rows):
    return spark.createDataFrame([(*x, 1, 2.0, "b", 3) for x in rows], "vec_id long, embedding array<float>, label int, part int, norm double, bucket string, dim int")


def test_negatives_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART", 60)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    r = random.Random(3)
    centre = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.6) for x in centre[i % 5]], r.choice([i % 5, i % 5, 7])) for i in range(500)]
    rows += [(500 + i, [1.0] * 6, 2) for i in range(150)]  # one very common vector, tied with itself
    rows += [(2000, None, 1), (2020, [1.0, None] * 3, 1), (2040, [float("nan")] * 6, 1), (2060, [float("inf")] * 6, 1), (2080, [], 1), (2081, [], 2), (2100, [0.0] * 6, 3), (2120, [1.0] * 6, None)]
    rows += [(None, [2.0] * 6, 2), (2140, [1.0, 2.0], 4), (40, rows[40][1], rows[40][2]), (40, rows[40][1], rows[40][2]), (None, [0.7] * 6, 3)]
    df = embedded(spark, rows)
    exact = [(x.vec_id, x.embedding, x.label) for x in df.collect()]
    want = brute_negatives(exact, 20, 7, 10, 5, 3)
    assert mined(df, 20) == want and len({x[2] for x in want}) == 3
    few = df.where("vec_id in (20, 21, 25, 2080, 2081)")
    assert mined(few, 20) == brute_negatives([(x.vec_id, x.embedding, x.label) for x in few.collect()], 20, 7, 10, 5, 3)
    assert not mined(df.limit(0), 20)


def test_scores_longer_than_a_long(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([3e38, 1e20, 1e17, 5.0]) * r.uniform(0.2, 1) for _ in range(6)], i % 3) for i in range(60)]
    df = embedded(spark, rows)
    got = mined(df, 10)
    assert got == brute_negatives([(x.vec_id, x.embedding, x.label) for x in df.collect()], 10, 7, 10, 5, 3)
    assert any(x[4] == 2**63 - 1 for x in got)


@pytest.mark.parametrize("most", [1, 300, 40_000, 2**31, 2**52, 2.0**90, 2.0**1022])
def test_products_of_residues_are_exact(most):
    rng = np.random.default_rng(int(most) % 97)
    q, p = (np.floor(rng.uniform(-most, most, size=(n, 700))) for n in (4, 9))
    q[0], p[0], p[1] = most, most, -most  # the largest and smallest scores that there are
    exact = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in p] for a in q]
    bound = float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(p, axis=1).max()) if most < 1e30 else 700 * int(most) ** 2
    assert hard_negatives.products(q, p, bound).tolist() == exact


def test_sums_of_residues_fit_float32():
    assert all(n * (p // 2) ** 2 < 1 << 24 for n in (hard_negatives.COLUMNS, hard_negatives.FEW_COLUMNS) for p in hard_negatives.primes(n))
    a = np.array([[-1e300, 1e300, -513.0, 513.0, 2.0**60 + 2**10]])
    for p in hard_negatives.primes()[:4]:
        own = hard_negatives.residues(a, p)[0]
        assert all(abs(x) <= p // 2 and (int(x) - int(y)) % p == 0 for x, y in zip(own, a[0]))


def test_doubles_of_any_size_take_part(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([1e305, 1e100, 5.0]) * r.uniform(0.2, 1) for _ in range(4)], i % 3) for i in range(40)] + [(40, [1.7e308] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df, 10) == brute_negatives(rows[:-1], 10, 7, 10, 5, 3)  # the last row's scaled components are beyond a double


def test_exceeding_scores_sort_as_numbers():
    scores = sorted([2**63 - 1, 2**63, 2**64, 10**30, 10**30 + 1, 9 * 10**29])
    texts = [hard_negatives._exceeding(s) for s in scores]
    assert texts == sorted(texts) and [hard_negatives._exact(0, t) for t in texts] == scores
    texts = [hard_negatives._exceeding(-s) for s in scores]
    assert texts == sorted(texts, reverse=True) and [hard_negatives._exact(0, t) for t in texts] == [-s for s in scores]
    assert hard_negatives._exceeding(2**63 - 2) is None


# ---- fill-in-the-middle ----


def brute_fim(doc_id, text, cut, suffix_first):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return doc_id, len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


FIM_SCHEMA = "doc_id long, text string, n string, form int, a long, b long, output string"
ODD = ["a<P>b", "<S>", "x<M>", "<", "<P", "<<S", "a<S<", ">P>", "M><", "$1 \\$2 \\", "\\Q a \\E", "a\nb\r\n c", "\U0001f600x\U0001f600", "é", "{3}+", "x" * 5000]


def fim_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    return rows + [(100 * k + i, t) for i, t in enumerate(ODD) for k in range(10, 16)]


@pytest.mark.parametrize("cut, suffix_first", [(90, 20), (100, 50)])
def test_fill_middle_is_that_of_brute_force(spark, odd_docs, cut, suffix_first):
    rows = fim_rows(odd_docs)
    docs = spark.createDataFrame([(*x, "n", 1, 2, 3, "o") for x in rows], FIM_SCHEMA)
    got = fill_middle.fill_middle(docs, cut=cut, suffix_first=suffix_first)
    got = got.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(brute_fim(*x, cut, suffix_first) for x in rows)
    assert Counter((r.doc_id, r.again) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(docs.limit(0)).count() == 0


def test_long_texts_are_cut_in_a_loop(spark):
    rows = [(1, "word é " * 300_000), (2, "a" * 2_000_000), (3, "\U0001d4b3\n" * 400_000), (4, "|" * 1_500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_middle.fill_middle(docs, cut=100)
    for r in got.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect():
        assert tuple(r)[:6] == brute_fim(r.doc_id, dict(rows)[r.doc_id], 100, 20) and r.again == dict(rows)[r.doc_id]


def test_fill_middle_shuffles_nothing(odd_docs):
    plan = fill_middle.fill_middle(odd_docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


# ---- window packing ----


def brute_best_fit(sizes, window):
    room, where = [], []
    for s in sizes:
        fits = [c for c in room if c >= s]
        if fits:
            i = max(i for i, c in enumerate(room) if c == min(fits))
        else:
            room.append(window)
            i = len(room) - 1
        room[i] -= s
        where.append(i)
    return len(room), Counter(room)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_takes_the_tightest_window(seed):
    r = random.Random(seed)
    window = r.choice([1, 7, 8, 64, 100])
    sizes = sorted((r.randint(1, window) for _ in range(400)), reverse=True)
    windows, offsets = window_packing.best_fit(sizes, window)
    held = Counter()
    for w, o, s in zip(windows, offsets, sizes):
        assert held[w] == o  # gapless, in the order of packing
        held[w] += s
    assert (len(held), Counter(window - n for n in held.values())) == brute_best_fit(sizes, window)


def test_tree_finds_the_least_capacity_that_is_enough():
    r, tree, have = random.Random(1), window_packing.Capacities(37), []
    for k in range(4000):
        if r.random() < 0.5:
            have.append(c := r.randint(1, 37))
            tree.add(c, k)
        else:
            least = r.randint(0, 37)
            want = min((c for c in have if c >= least), default=None)
            got = tree.take(least)
            assert (got and got[1]) == want
            if got:
                have.remove(want)


WORDS = ["don't", "It's", "Über", "été", "漢字かな", "x1y22", "<|endoftext|>", "a<|startoftext|>b", "ΣΣΣ", "İ", "#*$%", "\U0001f600", "ﬁn", "가", "'s", "z" * 100]


def test_ids_are_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(window_packing, "KNOWN", 40)  # so that generations go
    r = random.Random(2)
    gaps = [" ", "\n", "\t ", "\r\n", "  ", " ", " ", "　", "\x1c", "\x85", "\x0b", "\x0c", ""]
    texts = ["".join(r.choice(WORDS) + r.choice(gaps) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += ["", " ", "\n\t", *[r.choice(gaps) + x + r.choice(gaps) for x in texts[:100]]]
    tokenizer, encoder = Tokenizer.from_file(VOCABULARY), window_packing.Encoder(VOCABULARY)
    for at in range(0, len(texts), 16):
        got = encoder.ids([t.encode() for t in texts[at : at + 16]])
        want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts[at : at + 16], add_special_tokens=False)]
        assert got == want


def test_ids_of_latin_words_and_marks():
    """Letters that are given to the model at once, beside all that are near them."""
    r = random.Random(9)
    tokenizer, encoder = Tokenizer.from_file(VOCABULARY), window_packing.Encoder(VOCABULARY)
    assert encoder.plain and len(encoder.letters) > 400
    letters = [chr(c) for c in range(0x41, 0x260) if chr(c).isalpha()] + ["\u0301", "\u0327", "\u0130", "\u1100", "\u1161", "\u03a3"]
    marks = [*window_packing._MARKS, "'", "-", '"', "\u2019", "1"]
    words = ["".join(r.choice(letters if k % 2 else letters[:52]) for _ in range(r.randint(1, 9))) + "".join(r.choice(marks) for _ in range(r.choice([0, 0, 1, 2, 60]))) for k in range(6000)]
    words += [f"a{c}" for c in letters] + [f"{c}." for c in letters] + [c for c in letters]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.ids([t.encode() for t in texts]) == want and encoder.ids([t.encode() for t in texts]) == want


def check_packing(rows, docs, window):
    """rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; docs: (doc_id, text)."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), window):
            own = ids[s : s + window]
            want[doc_id, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    total = [sum(n for _, n in own) for own in held.values()]
    assert len(total) - sum(n == window for n in total) <= len(rows)
    return sum(window - n for n in total if n & (n - 1)), sum(total)


@pytest.mark.parametrize("group", [15, 10_000])
def test_window_packing(spark, odd_docs, no_docs, group, monkeypatch):
    monkeypatch.setattr(window_packing, "BYTES_AT_ONCE", group)
    odd = odd_docs.withColumns({"row": F.lit(1), "length": F.lit("x"), "grp": F.lit(None), "ids": F.lit(2)})
    got = window_packing.pack(odd, VOCABULARY, window=256, group=group).withColumn("ids_crc32", F.crc32("ids"))
    check_packing(got.collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 256)
    assert window_packing.pack(no_docs, VOCABULARY).count() == 0


def test_registered_packing_pads_little(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    padding, total = check_packing(queries.op13_pack_windows(spark, SF).collect(), docs, 2048)
    assert padding < 0.02 * total


def test_a_very_long_text_is_cut_into_windows(spark):
    docs = spark.createDataFrame([(1, "of the " * 200_000), (2, "x"), (3, "z" * 300_000)], "doc_id long, text string")
    rows = window_packing.pack(docs, VOCABULARY).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)


# ---- quality classifier ----


def test_scores_are_those_of_plain_compression(spark, odd_docs, words):
    """Scores from the definition: sizes under both dictionaries, piece by piece, then the logistic curve, whose fit is checked by its slope of loss."""
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(words) for _ in range(60))) if i % 3 else (i, " ".join(r.choice("#|!%") * 3 + r.choice(words).upper() for _ in range(50))) for i in range(400)]
    docs += [(900, "x" * 1_500_000), (901, "word é " * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    model = quality_classifier.fit(df, labels)

    def size(data: bytes, dictionary: bytes) -> int:
        press = zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False, write_checksum=False)
        step = quality_classifier.PIECE
        return sum(len(press.compress(data[k : k + step])) for k in range(0, len(data), step))

    def brute(text: str | None) -> float:
        data = (text or "").encode()
        x = (size(data, model.bad) - size(data, model.good)) / max(1, len(data))
        return 1 / (1 + math.exp(-(model.slope * x + model.offset)))

    own = {x.doc_id: x for x in quality_classifier.score(df, model).collect()}
    for i, t in docs[::7] + docs[-2:]:
        assert own[i].score == pytest.approx(brute(t), abs=1e-9) and own[i].predicted == int(own[i].score >= 0.7) and own[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    odd = Counter((x.doc_id, round(x.score, 9)) for x in quality_classifier.score(odd_docs, model).collect())
    assert odd == Counter((x.doc_id, round(brute(x.text), 9)) for x in odd_docs.collect())
