"""Packing, top-k, SimHash, WARC, quality rules and classifier, pipeline."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stallmap.llm import graph, packing, quality_classifier, quality_rules, simhash, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- packing ----


def brute_best_fit(sizes, lengths):
    bins, where, ahead = [], [], sum(sizes)  # bins: [length, held]
    for s in sizes:
        fits = [(b[0] - b[1], i) for i, b in enumerate(bins) if b[0] - b[1] >= s]
        if fits:
            i = min(fits)[1]
        else:
            bins.append([min((c for c in lengths if c >= s), key=lambda c: (packing.cost(c) / min(c, ahead), c)), 0])
            i = len(bins) - 1
        where.append(i)
        bins[i][1] += s
        ahead -= s
    return where, [min(c for c in lengths if c >= b[1]) for b in bins]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_that_of_brute_force(seed):
    r = random.Random(seed)
    sizes = sorted((r.choice([1, 5, r.randint(1, 64)]) for _ in range(300)), reverse=True)
    bins, offsets, final = packing.best_fit(sizes, (8, 16, 64))
    assert (bins, final) == brute_best_fit(sizes, (8, 16, 64))
    spans = sorted((b, o, o + s) for b, o, s in zip(bins, offsets, sizes))
    assert all(a[0] != b[0] or a[2] == b[1] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_lengths_are_chosen_together(seed):
    r = random.Random(seed)
    lengths = (512, 1024, 4096)
    sizes = sorted((r.choice([300, 480, 700, 1000, r.randint(1, 1024), r.randint(1, 4096) if seed % 2 else 5]) for _ in range(r.choice([3, 40]))), reverse=True)
    total = lambda got: sum(map(packing.cost, got[2]))
    got = packing.least_cost(sizes, lengths)
    ways = [packing.best_fit(sizes, own, lengths) for n in (1, 2, 3) for own in combinations(lengths, n) if own[-1] >= sizes[0]]
    assert total(got) == min(map(total, ways)) <= total(packing.best_fit(sizes, lengths))
    held = Counter()
    for b, s in zip(got[0], sizes):
        held[b] += s
    assert all(held[b] <= c and not any(held[b] <= x < c for x in lengths) for b, c in enumerate(got[2]))
    # Pieces of which two fill a short length go there, and not into longer ones that they leave half empty.
    assert set(packing.least_cost([300, 200] * 2, (512, 4096))[2]) == {512}


def test_pack_is_whole(odd_docs, no_docs):
    rows = packing.pack(odd_docs, group=15).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in odd_docs.collect())
    total = sum(len(WORD.findall(r.text or "")) + 1 for r in odd_docs.collect())
    assert sum(r.size for r in rows) == total and all(0 < r.size <= r.bin_length and r.bin_length in packing.LENGTHS for r in rows)
    held = Counter()
    for r in rows:
        held[r.bin, r.bin_length] += r.size
    assert len({b for b, _ in held}) == len(held)
    assert all(n <= c and not any(n <= x < c for x in packing.LENGTHS) for (_, c), n in held.items())
    assert packing.pack(no_docs).count() == 0


# ---- top-k ----


def brute_top(rows, every, k):
    out = []
    ok = [(i, v, [int(np.floor(1024.0 * float(x))) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    for i, v, a in ok:
        if v is not None and v % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), w is None, w or 0) for j, w, b in ok if j != i and len(a) == len(b))[:k]
            out += [(v, n + 1, None if null else w, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, null, w) in enumerate(found)]
    return Counter(out)


def test_topk(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 5) for _ in range(6)]) for i in range(700)]
    rows += [(700 + i, [1.0] * 6) for i in range(300)] + [(2000, None), (2005, [1.0, None] * 3), (2010, [float("nan")] * 6), (2015, [float("inf")] * 6), (2020, []), (2025, [0.0] * 6), (None, [2.0] * 6), (2030, [1.0, 2.0]), (35, [1.0] * 6)]
    df = spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "vec_id long, embedding array<float>, part int, norm double")
    exact = [(x.vec_id, x.embedding) for x in df.collect()]
    got = Counter(tuple(x) for x in topk.top(df, every=35, k=10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(exact, 35, 10)
    # Finite vectors of any length take part: their products are longer than a long, and ranked as whole numbers.
    huge = spark.createDataFrame([(35 * i, [r.choice([3e38, -3e38, 1e20, 1e17, 5.0]) for _ in range(6)], 1, 2.0) for i in range(40)] + [(7000, [], 1, 2.0), (7035, [], 1, 2.0)], df.schema)
    both = df.where("vec_id < 50").unionByName(huge)
    assert Counter(tuple(x) for x in topk.top(both, 35, 10).collect()) == brute_top([(x.vec_id, x.embedding) for x in both.collect()], 35, 10)
    few = df.where("vec_id < 4 or vec_id = 70")
    assert Counter(tuple(x) for x in topk.top(few, 35, 10).collect()) == brute_top([(x.vec_id, x.embedding) for x in few.collect()], 35, 10)
    assert topk.top(df.limit(0)).count() == 0


def test_pruned_search_is_exact():
    rng = np.random.default_rng(2)
    p = np.floor(1024 * rng.normal(size=(3000, 8)) * rng.lognormal(size=(3000, 1)))
    norm = np.sqrt((p**2).sum(1))
    order = np.argsort(-norm)
    p, norm = p[order], norm[order]
    q = p[::100]
    got = topk.search(q, norm[::100], np.arange(0, 3000, 100), np.full(30, -np.inf), p, norm, np.arange(3000), np.arange(3000), np.zeros(3000, bool), 5)
    for i, f in enumerate(got.found):
        s = p @ q[i]
        assert [(-a, c) for a, _, c in f] == sorted(((int(s[j]), int(j)) for j in range(3000) if j != 100 * i), key=lambda x: (-x[0], x[1]))[:5]


# ---- SimHash ----


def brute_fingerprint(text, shingle):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    """row -> least id of its class."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in fps)


def test_simhash_link(spark, odd_docs, words):
    r = random.Random(9)
    base = [r.choice(words) for _ in range(400)]
    near = [(2000 + i, " ".join([*base[:k], "changed", *base[k + 1 :]])) for i, k in enumerate(range(0, 400, 10))]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = Counter(tuple(x) for x in simhash.link(docs, 4, 4).collect())
    fps = [(x.doc_id, brute_fingerprint(x.text, 4)) for x in docs.collect()]
    assert got == brute_classes(fps)
    assert len({c for _, f, c in got}) < len({f for _, f, _ in got})


@pytest.mark.parametrize("width, half", [(64, 2), (32, 1)])
@pytest.mark.parametrize("t", [0, 1, 6, 10, 14])
def test_what_goes_to_groups_is_all_and_short(width, half, t):
    """Every variant is made just once, in the group of its own parity; few bytes go for each, however many groups there are."""
    r = random.Random(t)
    classes = simhash.Classes(width, half, t)
    fps = np.array([r.getrandbits(width) for _ in range(40)], np.uint64)
    groups, at, which = classes.entries(fps)
    variants, whose = classes.variants(fps[at], which)
    assert (classes.parity(variants) == groups[whose]).all()
    got = {(int(at[w]), int(v)) for v, w in zip(variants, whose)}
    expected = {(i, int(f) ^ sum(1 << b for b in c)) for i, f in enumerate(fps) for k in range(half + 1) for c in combinations(range(width), k)}
    assert got == expected and len(variants) == len(expected)
    assert len(groups) * 10 <= 4 * len(variants) or half == 1


@pytest.mark.parametrize("group", [4_000_000, 300_000])
def test_ball_links_find_all(spark, group, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", group)
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(3000)]
    for f in fps[:400]:
        for _ in range(3):
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
            fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    sigs = spark.createDataFrame([(s, bytearray(f.to_bytes(8, "big"))) for s, f in zip(signed, fps)], "node long, sig binary")
    roots = {x.node: x.root for x in graph.components(simhash.ball_links(sigs, 4)).collect()}
    classes = {}
    for s in signed:
        classes.setdefault(roots.get(s, s), set()).add(s % (1 << 64))
    expected = {}
    for (i, _, c), _ in brute_classes([(k, f) for k, f in enumerate(fps)]).items():
        expected.setdefault(c, set()).add(fps[i])
    assert {frozenset(x) for x in classes.values()} == {frozenset(x) for x in expected.values()}


def test_deduplicated(spark, odd_docs, no_docs, words):
    r = random.Random(11)
    base = [r.choice(words) for _ in range(500)]
    near = [(3000 + i, " ".join([*base[:k], "changed", *base[k + 1 :]])) for i, k in enumerate(range(3, 500, 40))]
    other = [(4000 + i, " ".join(r.choice(words) for _ in range(200))) for i in range(30)]
    docs = odd_docs.unionByName(spark.createDataFrame(near + other, "doc_id long, text string"), allowMissingColumns=True)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = Counter(x.doc_id for x in rows)
    assert ids[3000] == 1 and not any(3000 < i < 3100 for i in ids if i) and all(ids[i] == 1 for i, _ in other)
    texts = Counter(x.text for x in rows)
    assert max(texts.values()) == 1 and ids[3] == 1 and ids[0] == 1 and not ids[900] and not ids[901]
    assert sum(1 for t in texts if not WORD.search(t or "")) == 1
    assert simhash.deduplicated(no_docs).count() == 0 and simhash.link(no_docs).count() == 0


def jaccard(a, b):
    a, b = ({tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_deduplicated_verifies_similarity(spark, words):
    """Pairs at either side of 0.8; none under it goes, and few at 0.8 and more stay."""
    r = random.Random(23)
    docs, pairs = [], []
    for k in range(240):
        base = [r.choice(words) for _ in range(400)]
        other = list(base)
        for i in r.sample(range(400), 4 + k % 10):
            other[i] = "changed"
        a, b = " ".join(base), " ".join(other)
        pairs.append((2 * k, 2 * k + 1, jaccard(a, b)))
        docs += [(2 * k, a), (2 * k + 1, b)]
    # One shingle over and over makes all bits alike, though the sets are far apart.
    docs += [(9000 + i, "same " * 300 + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(2)]
    left = {x.doc_id for x in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    over, under = [p for p in pairs if p[2] >= 0.8], [p for p in pairs if p[2] < 0.8]
    assert min(len(over), len(under)) > 60 and max(p[2] for p in under) > 0.78
    assert all(a in left and b in left for a, b, _ in under) and {9000, 9001} <= left
    assert sum(b not in left for _, b, _ in over) >= 0.9 * len(over)


def test_crowded_variants_lose_no_pair(spark, words, monkeypatch):
    """A family of texts that share most of their words, far more than FEW in one variant: what is similar among
    strangers is found all the same."""
    monkeypatch.setattr(simhash, "FEW", 3)
    monkeypatch.setattr(simhash, "PIECE", 7)
    monkeypatch.setattr(simhash, "GROUP", 3000)
    r = random.Random(31)
    base, docs = [r.choice(words) for _ in range(300)], []
    for k in range(60):
        text = list(base)
        for i in r.sample(range(300), 14):
            text[i] = f"own{k}"
        docs.append((2 * k, " ".join(text)))
        text[r.randrange(300)] = "changed"
        docs.append((2 * k + 1, " ".join(text)))
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(docs, 2):
        if jaccard(a, b) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    left = {x.doc_id for x in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert left == {find(i) for i, _ in docs} and len(left) > 40


# ---- WARC ----


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>one</p>", "<p>one</p>", "", None, "é" * 50_000, "a\r\n\r\nb", "<p>one</p>", "x" * 3_000_000]
    rows = [(i, f"http://h/{i}" if i % 3 else None, h, "r") for i, h in enumerate(html)] + [(None, "u", "alone", "r"), (5, "again", "a\r\n\r\nb", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = Counter(tuple(x) for x in warc.page_records(pages, f"file://{tmp_path}/a").collect())
    firsts = {}
    for i, _, h, _ in rows:
        if i is not None:
            firsts[h or ""] = max(i, firsts.get(h or "", i))
    expected = Counter()
    for i, _, h, _ in rows:
        b, first = (h or "").encode(), firsts.get(h or "")
        again = first is not None and i != first and sum((x[2] or "") == (h or "") for x in rows) > 1
        expected[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    assert got == expected
    stored = spark.read.format("warc").option("path", f"file://{tmp_path}/a").load()
    assert {x.payload.decode() for x in stored.where("record_type = 'response'").collect()} == {h or "" for h in html} | {"alone"}
    assert stored.where("record_id in ('urn:page:4', 'urn:page:5') and startswith(target_uri, 'http')").count() == 2
    small = Counter(x.record_type for x in warc.page_records(pages, f"file://{tmp_path}/b", least_bytes=1).collect())
    assert small["revisit"] == sum(x[3] == "revisit" for x in expected.elements()) - 1
    assert warc.page_records(pages.limit(0), f"file://{tmp_path}/c").count() == 0


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_of_others(spark, tmp_path, zipped):
    """Without lengths in the gzip header, or not zipped at all."""
    parts = [warc.record(f"urn:page:{i}", "response", "u", b"z" * i * 5000, None, "1970-01-01T00:00:00Z") for i in range(4)]
    parts.insert(1, b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    (tmp_path / ("a.warc.gz" if zipped else "a.warc")).write_bytes(b"".join(gzip.compress(p) if zipped else p for p in parts))
    warc.register(spark)
    load = lambda payload: spark.read.format("warc").option("path", f"file://{tmp_path}").option("payload", payload).load()
    assert {(x.record_id, x.payload_length, len(x.payload)) for x in load("true").where("record_type = 'response'").collect()} == {(f"urn:page:{i}", 5000 * i, 5000 * i) for i in range(4)}
    assert {(x.record_type, x.payload) for x in load("false").collect()} == {("response", None), ("warcinfo", None)}


# ---- quality rules ----


def brute_features(text):
    t = text or ""
    words = WORD.findall(t)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, hit, seen, again = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(i, i + 5))
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), again, len(hit), failed


def test_quality_features(odd_docs, spark):
    r = random.Random(2)
    more = [(5000 + i, "\n".join(" ".join(r.choice(["a", "b", "c#"]) for _ in range(r.randint(0, 12))) for _ in range(8))) for i in range(40)] + [(6000, "the same five words here " * 30), (6001, "|# < > | a | b | c | d\n" * 2)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = quality_rules.judge(docs, odd_docs.select("doc_id").where("doc_id < 30")).collect()
    assert Counter(tuple(x)[:7] for x in rows) == Counter((x.doc_id, *brute_features(x.text)) for x in docs.collect())
    assert all(x.kept == (not x.base_failed and x.ratio >= quality_rules.THRESHOLD) for x in rows)


def brute_ratio(texts, trusted):
    def buckets(t):
        b = b" " + b" ".join((t or "").encode().split()) + b" "
        return [(int.from_bytes(b[i : i + 4], "little") * 2654435761 % 2**32) >> 16 for i in range(len(b) - 3)]

    raw, good = Counter(), Counter()
    for i, t in texts:
        raw.update(buckets(t))
        if i in trusted:
            good.update(buckets(t))
    total = (sum(raw.values()) + 65536, sum(good.values()) + 65536)
    return {i: float(np.mean([np.log((good[b] + 1) / total[1]) - np.log((raw[b] + 1) / total[0]) for b in buckets(t)] or [0.0])) for i, t in texts}


def test_quality_ratio(odd_docs, no_docs, spark):
    trusted = spark.createDataFrame([(1,), (2,), (2,), (None,), (7,)], "doc_id long")
    docs = odd_docs.where("doc_id < 43")
    expected = brute_ratio([(x.doc_id, x.text) for x in docs.collect()], {1, 2, 7})
    assert all(x.ratio == pytest.approx(expected[x.doc_id], abs=1e-4) for x in quality_rules.judge(docs, trusted).collect())
    kept = quality_rules.kept(odd_docs, trusted)
    assert kept.columns == odd_docs.columns and kept.count() == quality_rules.judge(odd_docs, trusted).where("kept").count()
    assert all(x.ratio == 0 for x in quality_rules.judge(docs, trusted.limit(0)).collect())
    assert quality_rules.judge(no_docs, trusted).count() == quality_rules.kept(no_docs, trusted).count() == 0


# ---- quality classifier ----


def test_classifier(spark, odd_docs, no_docs, words):
    r = random.Random(8)
    good = [(i, " ".join(r.choice(words) for _ in range(80))) for i in range(300)]
    bad = [(1000 + i, " | ".join(r.choice(words).upper() + "!!" for _ in range(40))) for i in range(120)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    # Labels of the held-out fold are wrong on purpose: they must not be read.
    marks = [(i, int(i < 1000), 0) for i, _ in good + bad]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0)], labels.schema))
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.score(docs, model).collect()
    right = [x.predicted == int(x.doc_id < 1000) for x in rows if x.held_out]
    assert len(right) > 50 and np.mean(right) > 0.97
    odd = quality_classifier.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in odd)
    assert quality_classifier.kept(docs, model).count() == sum(x.predicted for x in rows)
    assert quality_classifier.score(no_docs, model).count() == 0
    none = quality_classifier.fit(docs, labels.limit(0))
    assert len({x.score for x in quality_classifier.score(docs, none).collect()}) == 1
    assert {x.predicted for x in quality_classifier.score(docs, quality_classifier.fit(docs, labels.where("doc_id < 1000 and quality = 1"))).collect()} == {1}


# ---- graph ----


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(7, 7), (1, 0)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_size_steps_rule_out_no_similar_pair():
    """Of sets with a similarity of SIMILAR or more, the smaller has at least that share of the larger one's members."""
    for n in [*range(1, 3000), 10**5, 10**7]:
        least = math.ceil(n * simhash.SIMILAR)
        assert simhash._size_step(n) - simhash._size_step(least) <= simhash.SIZE_STEPS
    x = np.array([5 << 8 | simhash._size_step(100)], np.uint64)
    assert simhash._distance(x, np.array([4 << 8 | simhash._size_step(81)], np.uint64))[0] == 1
    assert simhash._distance(x, np.array([4 << 8 | simhash._size_step(40)], np.uint64))[0] == simhash.FAR
    assert simhash._distance(x, x ^ np.uint64((1 << 56) - 256))[0] == simhash.FAR


def test_crowded_variants_give_each_member_a_near_one_and_small_ones_all_pairs():
    rng = np.random.default_rng(4)
    few, many = simhash.FEW, 50 * simhash.FEW
    begin = np.repeat([0, few], [few, many])
    size = np.repeat([few, many], [few, many])
    name = np.arange(few + many)
    base = np.uint64(rng.integers(1 << 40)) << np.uint64(8)
    check = base ^ (np.uint64(1) << rng.integers(8, 64, few + many).astype(np.uint64))
    a, b, away = simhash._pairs(name, check, begin, size)
    got = set(zip(a.tolist(), b.tolist()))
    assert {(i, j) for j in range(few) for i in range(j)} <= got and (away <= 2).all()
    crowd = {(i, j) for i, j in got if j >= few}
    assert {j for _, j in crowd} == set(range(few + 1, few + many)) and len(crowd) == many - 1 and all(i >= few for i, _ in crowd)
