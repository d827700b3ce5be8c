"""Mixing, sharding, URL filter and licence scan."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from stallmap.llm import license_scan, mixing, sharding, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted_targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """By rounds: what is above the cap is split again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, out, open_ = {s: weights[i % 3] for i, s in enumerate(order)}, share * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def test_mix(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    texts = odd_docs.select("doc_id", "text", "source").collect()
    n = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((t.doc_id, n(t.text)) for t in texts)
    sizes = defaultdict(int)
    for t in texts:
        sizes[t.source] += n(t.text)
    goal, taken = wanted_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - goal[s]) <= max(r.size for r in rows if r.source == s)
    again = mixing.mix(odd_docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in rows)


def test_mix_many_rows_hit_the_target(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 7 AS INT)) AS text", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' ELSE 'c' END AS source")
    got = mixing.mix(docs, share=0.5).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 7


def test_mix_ends_its_sample_in_a_later_pass(spark, monkeypatch):
    """A bucket of more than LAST rows is looked at in another pass; the sample is the same."""
    docs = spark.range(1500).selectExpr("id doc_id", "repeat('a ', CAST(1 + id % 5 AS INT)) text", "CAST(id % 2 AS STRING) source")
    once = {r.doc_id: r for r in mixing.mix(docs, share=0.5).collect()}
    monkeypatch.setattr(mixing, "LAST", 0)
    monkeypatch.setattr(mixing, "SPLIT_BITS", 20)
    often = {r.doc_id: r for r in mixing.mix(docs, share=0.5).collect()}
    assert once == often
    for source in "01":
        own = [r for r in often.values() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5


def test_mixed_rows_are_those_allotted(odd_docs):
    got = mixing.mixed(odd_docs)
    assert got.columns == odd_docs.columns
    allotted = Counter()
    for r in mixing.mix(odd_docs).collect():
        allotted[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +allotted


def test_empty_tables(no_docs, spark):
    assert mixing.mix(no_docs).count() == mixing.mixed(no_docs).count() == 0
    assert sharding.shard(no_docs).count() == 0
    assert license_scan.scan(no_docs).count() == 0
    pages, none = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string")
    assert url_filter.judge(pages, none).count() == 0


def brute_minimax(sizes, shards):
    n, best = len(sizes), sum(sizes)
    for cuts in combinations(range(n + 1), shards - 1):
        edges = [0, *cuts, n]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_cut_is_minimax(seed):
    r = random.Random(seed)
    sizes, shards = [r.choice([1, 2, 3, 50, r.randint(1, 30)]) for _ in range(r.randint(1, 9))], r.randint(1, 4)
    starts = sharding.cut(sizes, shards)
    edges = [0, *starts, len(sizes)]
    assert edges == sorted(edges) and len(edges) == shards + 1
    assert max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) == brute_minimax(sizes, shards)


def test_shards(odd_docs, spark):
    hot = spark.range(3000).selectExpr("id + 5000 AS doc_id", "'one very common text' AS text")
    docs = odd_docs.select("doc_id", "text").unionByName(hot)
    rows, shards = sharding.shard(docs, 5).collect(), defaultdict(list)
    of_text = defaultdict(set)
    for r in rows:
        shards[r.shard].append(r.slot)
        of_text[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(5))
    assert all(len(s) == 1 for s in of_text.values())
    expected = Counter((x.doc_id, len((x.text or "").encode()) + 16, zlib.crc32((x.text or "").encode())) for x in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected


def test_near_equal_shards(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id, repeat('x', CAST(id % 50 AS INT))) AS text")
    sums = [r["sum(size)"] for r in sharding.shard(docs, 8).groupBy("shard").sum("size").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 200


@pytest.mark.parametrize("seed", range(5))
def test_cells_are_dealt_near_equally(seed):
    r = random.Random(seed)
    cells = [(c, r.choice([50, 400, r.randint(16, 3000), 20_000 if r.random() < 0.02 else 80])) for c in r.sample(range(65536), 1000)]
    held, of = Counter(), sharding.plan(cells, 40)
    for c, n in cells:
        held[of[c]] += n
    total, largest = sum(held.values()), max(n for _, n in cells)
    assert set(of) == {c for c, _ in cells} and len(held) == 40
    if largest * 40 <= total:
        assert max(held.values()) - min(held.values()) <= 0.01 * total / 40
    # One cell with half of all: it stands alone, and the others share the rest equally.
    of, held = sharding.plan([*cells, (70_000, total)], 40), Counter()
    for c, n in cells:
        held[of[c]] += n
    assert of[70_000] not in held and len(held) == 39


def brute_verdict(url, listed):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = re.split(r"[?#]", rest, maxsplit=1)[0]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    name = re.sub(r"^www\.", "", re.sub(r":\d*$", "", host)) + re.sub(r"/+$", "", re.sub(r"/index\.html?$", "", path))
    return host, path, None, "block" if name in listed else "allow"


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/1", "https://www.example.com/en/", "http://example.com/fr/?q=/en/", "ftp://x.net/fr/a#b", "net/es/", None, "", "http://", "x://y://z/", "http://net/es/",
            "http://spam.org:80/a/index.html?x#y", "http://www.spam.org/a/", "http://spam.org/b", "http://notcom/", "http://xnet/es/", "http://q.com", "HTTP://ÄB.org/ß", "http://spam.org/a\nb"]
    r = random.Random(1)
    urls += [f"http://h{r.randint(0, 40)}.org/{r.randint(0, 40)}" for _ in range(600)] + ["http://spam.org/a"] * 300
    listed = {"spam.org/a", *(f"h{i}.org/{j}" for i in range(0, 40, 3) for j in range(0, 40, 5))}
    pages = spark.createDataFrame([(i if i % 50 else None, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, block int")
    rows = url_filter.judge(pages, spark.createDataFrame([(x,) for x in [*listed, None, "spam.org/a"]], "url string")).collect()
    expected = Counter((i if i % 50 else None, *brute_verdict(u, listed)) for i, u in enumerate(urls))
    assert Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in rows) == expected


def test_bloom_lets_all_listed_urls_pass(spark):
    listed = spark.range(500).selectExpr("concat('u', id) AS url")
    b = url_filter.bloom(listed, 7).collect()
    assert len(b) == 7 and all(bin(getattr(r, f"w{k}") & (2**64 - 1)).count("1") > 5 for r in b for k in range(8))


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark, odd_docs):
    lines = ["Released under the MIT License.", "MIT license MIT LICENSE", "mit--license/apache_license", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "All rights reserved.",
             "smit license mit licenses", "MIT\u00a0License", "the mit", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under CC BY-NC 4.0.", "license " * 500 + "mit license " * 400]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, x) for i, x in enumerate(lines)], "doc_id long, text string"))
    rows = license_scan.scan(docs).collect()
    expected = Counter((x.doc_id, *brute_base(x.text)) for x in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == expected
    by = {r.doc_id: r for r in rows if r.doc_id and r.doc_id >= 1000}
    assert by[1003].labels == "apache,apache2" and by[1009].labels == "bsd3" and by[1010].labels == "cc-by-nc" and by[1005].labels == "all-rights-reserved"
    assert all(0 <= r.score <= 1 and (not r.base_labels or set(r.base_labels.split(",")) <= set(r.labels.split(","))) for r in rows)


def test_contained_detections_go(spark):
    texts = spark.createDataFrame([(1, " released under the mit license and the mit license ")], "uid long, line string")
    found = license_scan.detections(texts)
    kept = {(r.start, r.stop, r.base) for r in license_scan.resolved(found).collect()}
    assert (0, 5, False) in kept and (3, 5, True) in kept and (7, 9, True) in kept
    assert not any(not base and (s, e) in ((3, 5), (2, 5), (7, 9)) for s, e, base in kept)


def test_hundreds_of_rules():
    rules = license_scan.rules()
    assert len(rules) > 200 and all(re.compile(r[3]) for r in rules)


def expansions(pattern, whole):
    """Strings that a rule's pattern matches, with all its optional parts or without: one for each alternative."""

    def of(items):
        out = [""]
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                ways = [chr(arg)]
            elif op == "IN":
                ways = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
            elif op == "BRANCH":
                ways = [w for x in arg[1] for w in of(x)]
            elif op == "SUBPATTERN":
                ways = of(arg[-1])
            elif op == "MAX_REPEAT":
                ways = of(arg[2]) if whole or arg[0] else [""]
            else:
                raise ValueError(op)
            out = [a + b for a in out for b in ways]
        return out

    return of(re._parser.parse(pattern))


def test_every_license_rule_fires_through_scan(spark):
    known = license_scan.rules()
    assert len(known) == 305
    docs, wanted = [], {}
    for rule, label, _, pattern, *_ in known:
        core = pattern.removeprefix("(?<= )").removesuffix("(?= )")
        for text in {t for whole in (False, True) for t in expansions(core, whole)}:
            assert re.fullmatch(core, text)
            for gap in (" ", " \n", "-"):
                wanted[len(docs)] = (rule, label, len(text.split()))
                docs.append((len(docs), f"xyz{gap}{text.upper().replace(' ', gap)}."))
    rows = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs) and {wanted[r.doc_id][0] for r in rows} == set(range(305))
    for r in rows:
        _, label, n = wanted[r.doc_id]
        # By the rule, or by one of its label or of higher priority that takes in all of it.
        assert r.n_words == n + 1 and r.score > 0 and (label in r.labels.split(",") or any(d.start <= 1 and d.stop >= n + 1 for d in r.detections)), docs[r.doc_id]


@pytest.mark.parametrize("text, label", [
    ("Released under the MIT.", "mit"), ("distributed under GPL", "gpl"), ("published under CC BY 4.0", "cc-by"), ("Subject to the terms of the zlib.", "zlib"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose", "isc"),
    ("given to the public\ndomain", "public-domain"), ("Creative  Commons-Attribution", "cc-by"),
])
def test_license_forms_without_a_stem(spark, text, label):
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == label and row.score > 0
