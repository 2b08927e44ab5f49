"""Packing: validity, and the tightest compatible bin at every step."""

import random
from collections import Counter, defaultdict

from tradelens.llm import packing


def naive(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fit = [(capacity - b[0], i) for i, b in enumerate(bins) if capacity - b[0] >= size and capacity > b[0]
               and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([0, set(), set()])
        out.append((i, bins[i][0]))
        bins[i][0] += size
        bins[i][1].add(s)
        bins[i][2].add(c)
    return [i for i, _ in out], [o for _, o in out]


def test_same_bins_as_a_full_search():
    rnd = random.Random(1)
    for kind in range(40):
        n = rnd.randint(0, 400)
        hot = rnd.random()
        sizes = [rnd.randint(1, 100) for _ in range(n)]
        sources = [None if rnd.random() < .1 else 0 if rnd.random() < hot else rnd.randint(1, 30) for _ in range(n)]
        clusters = [None if rnd.random() < .3 else rnd.randint(0, 5) if kind % 2 else rnd.randint(0, 300) for _ in range(n)]
        if kind % 3:
            sizes.sort(reverse=True)
        assert packing.best_fit(sizes, sources, clusters, 100) == naive(sizes, sources, clusters, 100)


def check(rows, out, capacity):
    want = Counter()
    for i, text, _, source, *_ in rows:
        n = len((text or "").encode()) + 1
        for k, a in enumerate(range(0, n, capacity)):
            want[i, k, a, min(capacity, n - a), source] += 1
    assert Counter((r.doc_id, r.piece, r.start, r["size"], r.source) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.bin_start)
        assert members[0].bin_start == 0 and members[-1].bin_start + members[-1]["size"] <= capacity
        assert all(a.bin_start + a["size"] == b.bin_start for a, b in zip(members, members[1:]))
        for column in ("source", "cluster"):
            used = [r[column] for r in members if r[column] is not None]
            assert len(used) == len(set(used))


def test_documents(spark, small_docs):
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"]) for d in small_docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    check(rows, packing.op8(df).collect(), packing.CAPACITY)
    check(rows, packing.pack_documents(df, 3000, 40).collect(), 3000)


def test_odd_documents(odd_docs):
    rows, df = odd_docs
    check(rows, packing.op8(df).collect(), packing.CAPACITY)
    check(rows, packing.pack_documents(df, 64, 10).collect(), 64)
    assert packing.op8(df.limit(0)).collect() == []


def test_hot_source_and_repeated_rows(spark):
    rows = [(7, "same text", "en", "hot")] * 300 + [(i, f"text {i}", "en", f"s{i % 9}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    check(rows, packing.pack_documents(df, 64, 200).collect(), 64)
