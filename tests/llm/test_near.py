"""Near-duplicates between texts and components, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from stallmap.llm import simhash


def shingles(text: str) -> set[str]:
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def test_closest_members_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64))
    some = lambda: np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.5]), rng.integers(0, 1 << 62, 60).astype(np.uint64), base)[: rng.integers(1, 61)])
    texts, members = [some() for _ in range(80)], [some() for _ in range(50)] + [base]
    texts += [np.zeros(0, np.uint64), base]
    got = dict(simhash._closest(texts, members))
    for k, x in enumerate(texts):
        best = max(simhash.similarity(x, m) for m in members)
        assert (k in got) == (best >= simhash.SIMILAR) and (k not in got or simhash.similarity(x, members[got[k]]) == best)
    assert 20 < len(got) < 80


@pytest.mark.parametrize("part", [4, 1000])
def test_askers_meet_all_members(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    r = random.Random(part)
    sets, asks, members = {}, [], []
    for root in (100, 200):
        base = r.sample(range(10**9), 40)
        for k in range(30):
            node = root + k
            sets[node] = {x if r.random() > 0.08 else r.randrange(10**9) for x in base}
            members.append((root, node))
        for k in range(15):
            node = 10 * root + k
            sets[node] = {x if r.random() > 0.12 else r.randrange(10**9) for x in base}
            asks.append((node, root))
    df = spark.createDataFrame([(n, bytearray(np.array(sorted(s), np.uint64).tobytes())) for n, s in sets.items()], "n long, shingles binary")
    got = simhash.joined(spark.createDataFrame(asks, "node long, root long"), spark.createDataFrame(members, "root long, node long"), df)
    links = {(x.a, x.b) for x in got.collect()}
    near = {(a, m) for a, root in asks for own, m in members if own == root and alike(sets[a], sets[m]) >= 0.8}
    assert links <= near and {a for a, _ in links} == {a for a, _ in near} and 5 < len({a for a, _ in near}) < 30


def test_what_is_near_a_large_group_makes_no_pairs(spark, words, monkeypatch):
    """A large group of near copies, and texts somewhat like all of them: few pairs, and just the links that there are."""
    monkeypatch.setattr(simhash, "FEW", 4)
    pairs, own = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda p, sets: pairs.append(p.count()) or own(p, sets))
    r = random.Random(6)
    base, docs = [r.choice(words) for _ in range(300)], []

    def changed(n: int) -> str:
        text = list(base)
        for i in r.sample(range(300), n):
            text[i] = f"own{r.randrange(10**6)}"
        return " ".join(text)

    docs = [(k, changed(2)) for k in range(120)] + [(1000 + k, changed(14)) for k in range(40)] + [(2000 + k, " ".join(r.choice(words) for _ in range(80))) for k in range(20)]
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, _), (j, _) in combinations(docs, 2):
        if alike(sets[i], sets[j]) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    left = {x.doc_id for x in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert left == {find(i) for i, _ in docs} and len(left) > 30
    # 40 x 120 pairs stand between the group and what lies just outside it.
    assert sum(pairs) < 160 * 17 + 40 * 39


@pytest.mark.parametrize("block, piece", [(1 << 14, 1 << 14), (16, 2)])
def test_a_family_meets_in_few_rows_and_loses_no_pair(spark, monkeypatch, block, piece):
    """Signatures some bits from one another: what meetings() puts out grows with the texts, not with their variants or pairs, and
    the pairs that it leaves out come from crossing()."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = np.random.default_rng(8)
    n, base = 150, rng.integers(0, 2, 256)
    bits = np.array([base ^ (rng.random(256) < rng.choice([0.01, 0.04, 0.1])) for _ in range(n)], np.uint8)
    sig = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    sigs = spark.createDataFrame([(i, bytearray(x.astype(">u8").tobytes()), 100) for i, x in enumerate(sig)], "node long, sig binary, size long")
    met = simhash.materialize(simhash.meetings(sigs), "met")
    rows = met.collect()
    assert len(rows) <= n * simhash.WORDS * (simhash.PAIRS + 2)
    crowd, roots = {x.a for x in rows if x.away is None}, np.arange(n) // 2
    asks = sigs.where(f"node in ({','.join(map(str, crowd))})").selectExpr("node", "sig", "size", "node div 2 as root", "2L as members")
    got = {(x.node, x.root) for x in simhash.crossing(simhash.materialize(asks, "crowd")).collect()}
    fps, pairs = simhash.chosen_bits(sig, simhash.choices()), {(min(x.a, x.b), max(x.a, x.b)) for x in rows if x.away is not None}
    check, needed, allowed = sig[:, 0] >> np.uint64(8) << np.uint64(8) | np.uint64(100), set(), set()
    for i, j in combinations(range(n), 2):
        if roots[i] != roots[j] and np.bitwise_count(fps[i] ^ fps[j]).min() <= simhash.RADIUS and simhash._distance(check[i], check[j]) < simhash.FAR:
            allowed.add((i, int(roots[j])))
            if np.bitwise_count(sig[i] ^ sig[j]).sum(dtype=np.int64) <= simhash.WHOLE_LIMIT and (i, j) not in pairs:
                needed.add((i, int(roots[j])))
    assert len(needed) > 3000 and needed <= got <= allowed


@pytest.mark.parametrize("part", [8, 1000])
def test_families_are_held_against_themselves(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "ASKED", 5)
    r = random.Random(part)
    few = [(k, 100) for k in range(9)] + [(200 + k, 300 + k) for k in range(20)] + [(200, 301)]
    kin = {x.node: x.family for x in simhash.families(spark.createDataFrame(few, "a long, b long")).collect()}
    assert kin == {x: 0 for x in [*range(9), 100]}
    base, sets = r.sample(range(10**9), 40), {}
    for node in range(60):
        like = sets[node - 1] if node % 3 else base
        sets[node] = {x if r.random() > (0.05 if node % 3 else 0.3) else r.randrange(10**9) for x in sorted(like)}
    df = spark.createDataFrame([(n, bytearray(np.array(sorted(s), np.uint64).tobytes())) for n, s in sets.items()], "n long, shingles binary")
    links = {(x.a, x.b) for x in simhash.within(spark.createDataFrame([(n, 0) for n in sets], "node long, family long"), df).collect()}
    root = {n: n for n in sets}

    def joined(edges):
        root = {n: n for n in sets}
        for _ in sets:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    near = {(a, b) for a, b in combinations(sets, 2) if alike(sets[a], sets[b]) >= 0.8}
    assert joined(links) == joined(near) != root and len(set(joined(near).values())) > 10
