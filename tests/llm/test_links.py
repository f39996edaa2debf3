"""URL filters, components, near-duplicates and decontamination."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from hydrolattice.llm import decontamination, near_dups, url_filters
from hydrolattice.llm.components import components
from hydrolattice.llm.queries import QUERIES, URL_RULES
from hydrolattice.llm.shingles import BulkHashes

from .common import documents, groups, shingles, words

FOLDER = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges if None not in e for n in e}
    for _ in range(60):
        for a, b in (e for e in edges if None not in e):
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    link, refresh = '<link rel="canonical" href="{}">', "<META http-equiv='refresh' content='0; url={}'>"
    rows = [
        (1, "http://A.Example.NET/en/x", ""), (2, "http://example.net/EN/", None), (3, "http://x.org/fr/", ""), (4, "http://example.net", ""), (5, None, ""), (6, "no address", ""),
        (7, "https://mirror.example/1", link.format("http://example.com/de/p?x=1&amp;y=2")), (8, "http://other.example/2", refresh.format("//mirror.example/1")),
        (9, "http://both.example/a", link.format("http://net/q")), (10, "http://both.example/b", link.format("/a")), (11, "http://example.net/en/free", link.format("http://both.example/b")),
        (12, "http://example.com/de/p?x=1&y=2#part", ""), (13, "http://notexample.com/de/", ""), (13, "http://notexample.com/de/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = url_filters.judge_urls(pages, ["page_id"], URL_RULES, url_filters.page_links(pages))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "/EN/", "net/", "block")
    assert got[3][2:] == ("org/fr/", "allow") and got[4] == ("example.net", "", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == got[8][2:] == (None, "block") and got[12][2:] == ("example.com/de/", "block")
    assert got[9][2:] == got[10][2:] == (None, "allow") and got[11][3] == "allow"  # an allowed address is in this group
    assert got[13][2:] == (None, "allow")


def family(rng, n, size, edits):
    base = [f"b{i}" for i in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_equal_all_pairs(spark, percent):
    """Families around the threshold, whose links do not all run through one text."""
    rng = random.Random(percent)
    texts = family(rng, 60, 150, 5) + family(rng, 30, 60, 2) + family(rng, 8, 9, 1) + [None, "", " \n", "one", "one", "ONE", "a b c", "a b c d", "x " * 20_000, "x " * 20_000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[0]), (2000, texts[0]), (2000, "quite another text than that"), (2001, "quite another text than that")]
    found = near_dups.near_duplicates(documents(spark, rows).repartition(5), linking=near_dups.Linking(percent=percent)).collect()
    want = groups(rows, percent)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]), r


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words are here now and then"), (None, "a b c d e f g h"), (4, None), (5, "")]
    docs = documents(spark, rows)
    left = near_dups.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 3, 4, 5]
    assert near_dups.one_of_each(documents(spark, [])).count() == 0


def test_intersections_and_signatures():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 300)).astype(np.uint64)) for _ in range(80)]
    got = near_dups.intersections(sets[:40], sets[40:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[40:]] for a in sets[:40]]).all()
    sketcher = near_dups.Sketcher(near_dups.Linking())
    for n in (1, 2, 5, 1000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        signature = sketcher.signature(s)
        assert set(signature.tolist()) <= set(s.tolist()) and len(sketcher.bands(s)) == 48


@pytest.mark.parametrize("matching", [decontamination.Matching(), decontamination.Matching(radius=13, blocks=7)])
def test_hamming_index_finds_everything_within_the_radius(matching):
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 40).astype(np.uint64)
    asked = np.array([int(items[k % 40]) ^ sum(1 << int(b) for b in rng.choice(64, k % 30, replace=False)) for k in range(400)], np.uint64)
    index = decontamination.HammingIndex(items, matching)
    want = {(i, j) for i, a in enumerate(asked.tolist()) for j, b in enumerate(items.tolist()) if bin(a ^ b).count("1") <= matching.radius}
    assert set(index.within(asked)) == want


def test_recall_of_the_index_alone(spark):
    """Copies at the threshold, without the bound that catches the rest."""
    rng = random.Random(5)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    items = [fill(rng.randrange(13, 95)) for _ in range(300)]
    texts = [" ".join([*fill(3), *fill(max(1, len(i) // 10)), *i[max(1, len(i) // 10) :], *fill(4)]) for i in items]
    finder = decontamination.Benchmark([(k, " ".join(i)) for k, i in enumerate(items)], decontamination.Matching())
    whole = {(k, m[0]) for k, found in enumerate(finder.matches(texts)) for m in found}
    finder.confirmed = lambda hashes, rest: []
    alone = {(k, m[0]) for k, found in enumerate(finder.matches(texts)) for m in found}
    assert alone <= whole and len(whole) > 150 and len(alone) >= 0.995 * len(whole)


def test_matches_do_not_depend_on_blocks_of_items(spark, monkeypatch):
    rng = random.Random(6)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    common = fill(14)
    rows = [(k, " ".join([*common, *fill(12)] if k % 2 else fill(26))) for k in range(40)]
    texts = [(k, " ".join([*t.split()[:-n], *fill(n)])) for k, t in rows for n in (1, 2, 3)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    found = []
    for block in (100_000, 8, 2):
        monkeypatch.setattr(decontamination, "ITEMS_PER_BLOCK", block)
        found.append(sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontamination.leaks(documents(spark, texts), items, ["doc_id"]).collect()))
    assert found[0] and found[0] == found[1] == found[2]


def test_leaks(spark):
    rng = random.Random(4)
    fill = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    passage = " ".join(f"p{i}" for i in range(40))
    near = passage.split()
    near[-1] = "changed"
    rows = [(1, f"{fill(200)} {passage.upper()}\n{fill(9)}"), (2, fill(300)), (3, " ".join(near)), (4, None), (5, ""), (6, " ".join(passage.split()[:20])), (7, passage), (7, passage), (None, passage), (8, "two words")]
    items = spark.createDataFrame([(10, passage), (11, None), (12, ""), (13, fill(30)), (14, "two words"), (10, passage)], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["item_id"], round(r["similarity"], 2)) for r in decontamination.leaks(documents(spark, rows), items, ["doc_id"]).collect())
    assert [f[:2] for f in found] == [(0, 10), (1, 10), (3, 10), (7, 10), (7, 10), (8, 14)]
    left = decontamination.clean(documents(spark, rows), items)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6] and left.columns == documents(spark, []).columns
    assert decontamination.leaks(documents(spark, []), items, ["doc_id"]).count() == 0
    assert decontamination.leaks(documents(spark, rows), items.limit(0), ["doc_id"]).count() == 0


def test_leak_query_finds_every_whole_passage(spark):
    docs = {r["doc_id"]: f" {' '.join(words(r['text']))} " for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    want = {(i, r["item_id"]) for r in items for i, t in docs.items() if f" {' '.join(words(r['text']))} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"].run(spark, FOLDER).collect()}
    bags = {r["item_id"]: shingles(r["text"]) for r in items}
    assert want <= got
    for i, k in got - want:  # near copies hold most of the item's shingles
        assert len(bags[k] & shingles(docs[i])) >= 0.75 * len(bags[k])




def direct_matches(texts, items):
    """(text, item) pairs by comparing every window of every text with every item."""
    def bag(w):
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    bags = [bag(words(t)) for t in items]
    spread = Counter(s for b in bags for s in b)
    weigh = lambda s: math.log1p(len(items) / spread[s]) if s in spread else math.log1p(len(items))
    found = set()
    for k, text in enumerate(texts):
        w = words(text)
        for i, own in enumerate(bags):
            size = len(words(items[i]))
            for a in range(max(1, len(w) - size + 1)) if own.keys() & bag(w).keys() else ():
                other = bag(w[a : a + size])
                both, every = (sum(weigh(s) * f(own[s], other[s]) for s in own | other) for f in (min, max))
                if both >= (0.8 - 1e-9) * every:
                    found.add((k, i))
    return found


def matched(texts, items):
    finder = decontamination.Benchmark(list(enumerate(items)), decontamination.Matching())
    return {(k, m[0]) for k, found in enumerate(finder.matches(texts)) for m in found}


def test_near_copies_at_the_threshold_equal_all_windows():
    rng = random.Random(7)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    common = fill(12)
    items, texts = [], []
    for size, changed in [(13, 1), (22, 2), (31, 3), (49, 5), (94, 10)] * 24:
        item = fill(size) if len(items) % 3 else [*common, *fill(size - 12)] if size > 12 else fill(size)
        items.append(" ".join(item))
        texts.append(" ".join([*fill(3), *fill(changed), *item[changed:], *fill(4)]))
        more = list(item)
        for _ in range(rng.randrange(1, 4)):
            more[rng.randrange(size)] = "changed"
        texts.append(" ".join([*fill(2), *more, *fill(2)]))
    want = direct_matches(texts, items)
    assert len(want) > 120 and matched(texts, items) == want


def test_texts_shorter_than_their_item():
    rng = random.Random(8)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    items = [fill(n) for n in (3, 5, 6, 15, 30, 48, 59)]
    texts = [" ".join(item[a : len(item) - b]) for item in items for a in range(4) for b in range(4)]
    items = [" ".join(item) for item in items]
    found = matched(texts, items)
    assert found == direct_matches(texts, items)
    assert {(i * 16 + b, i) for i in (4, 5, 6) for b in range(3)} <= found  # without the last one or two words


def test_bulk_hashes_tell_words_apart():
    texts = ["One two  ONE\nthree", "", " \t", "two é É", "ab", "a b", "one"]
    hashes, places = BulkHashes()(texts)
    every = [w for t in texts for w in words(t)]
    assert len(hashes) == len(every) and places.tolist() == [0, 4, 4, 4, 7, 8, 10, 11]
    assert all((hashes[i] == hashes[j]) == (every[i] == every[j]) for i in range(len(every)) for j in range(len(every)))
