"""Near duplicates against brute force over full sets."""

import random
import re

import numpy as np

from tradelens.llm import graph, neardup
from tradelens.llm.common import read_table


def shingles(text, width=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent):
    """doc_id -> (set size, component), by an inverted index over every shingle."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    shared = {}
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[a, b] = shared.get((a, b), 0) + 1
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(rows, out):
    want = brute(rows, 85)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_test_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, neardup.op4(docs).collect())


def variants(seed, n_groups, size):
    """Groups of texts that differ in a few words, chains among them, similarities around the threshold."""
    rnd, rows = random.Random(seed), []
    for g in range(n_groups):
        words = [f"w{rnd.randint(0, 4000)}" for _ in range(rnd.choice([40, 90, 200]))]
        for _ in range(size):
            words = list(words) if rnd.random() < 0.5 else words
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 10 ** 6)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    rnd.shuffle(rows)
    return rows


def test_chains_and_borderline_pairs(spark):
    for seed in (1, 2):
        rows = variants(seed, 12, 14)
        check(rows, neardup.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_large_buckets_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = variants(5, 4, 40)
    check(rows, neardup.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_odd_documents(odd_docs, spark):
    rows, df = odd_docs
    out = neardup.op4(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i in (0, 1, 2):
        assert (by[i].n_shingles, by[i].component_id, by[i].kept) == (0, i, True)
    assert (by[6].component_id, by[6].kept, by[11].component_id, by[14].component_id) == (5, False, 4, 13)
    assert (by[5].n_shingles, by[4].n_shingles) == (3, 1)
    assert (by[None].component_id, by[None].kept) == (None, True)
    assert neardup.op4(df.limit(0)).collect() == []
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((str(r.doc_id) for r in kept.collect()))
    assert ids == sorted(map(str, [0, 0, 1, 2, None, 4, 5, 7, 8, 9, 10, 12, 13]))


def test_rows_that_share_a_null_or_repeated_id(spark):
    """Nodes are texts: copies without a doc_id are found, and other texts of the same id stay."""
    def text(c, last="z"):
        return " ".join([f"{c}{i}" for i in range(80)] + [last])
    rows = [(1, text("a")), (7, text("a", "y")), (7, text("b")), (7, text("b", "y")), (None, text("c")), (None, text("c", "y")),
            (None, text("d")), (None, text("d")), (None, text("a")), (None, text("e")), (9, text("f")), (9, text("f")), (None, ""), (None, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    # the query's column follows its contract, by doc_id; the operator keeps one row of each component
    contract = neardup.op4(df).collect()
    assert len(contract) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in contract)
    assert [r.kept for r in contract if r.doc_id == 9] == [True, True]
    out = neardup.near_duplicates(df, percent=85).collect()
    assert len(out) == len(rows)
    assert sorted((str(r.component_id), r.n_shingles) for r in out if r.kept) == sorted(
        [("1", 77), ("7", 77), ("None", 77), ("None", 77), ("None", 77), ("9", 77), ("None", 0), ("None", 0)])
    kept = [(r.doc_id, r.text) for r in neardup.one_of_each(df).collect()]
    assert len(kept) == 8 and (1, text("a")) in kept and (9, text("f")) in kept and kept.count((None, "")) == 2
    assert sorted(t.split()[0] for _, t in kept if t) == ["a0", "b0", "c0", "d0", "e0", "f0"]
    assert sorted(t.split()[0] for i, t in kept if i == 7) == ["b0"]
    assert sorted(t.split()[0] for i, t in kept if i is None and t) == ["c0", "d0", "e0"]


def test_bands_follow_the_threshold():
    assert neardup.banding(85) == (32, 6) and neardup.banding(80) == (38, 5)
    for percent in range(40, 100, 5):
        bands, rows = neardup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 3e-7 and bands * rows <= 192


def test_recall_at_the_pipelines_threshold(spark):
    """Every link at 0.8 and above, many of them just there."""
    rnd, rows = random.Random(8), []
    for g in range(150):
        words = [f"g{g}w{i}" for i in range(104)]  # 100 shingles; one changed word in the middle changes 5
        rows.append((10 * g, " ".join(words)))
        for k, changes in enumerate((1, 2, 2, 2, 3)):  # 95/105, 90/110 = 0.818, 85/115
            other = list(words)
            for place in rnd.sample(range(5, 100, 6), changes):
                other[place] = f"x{rnd.randint(0, 10 ** 9)}"
            rows.append((10 * g + k + 1, " ".join(other)))
    want = brute(rows, 80)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.doc_id != want[r.doc_id][1] for r in out) > 500
    assert [r.doc_id for r in out if (r.n_shingles, r.component_id) != want[r.doc_id]] == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    m = 4096 // 2
    for share in (0.2, 0.5, 0.85, 0.95):
        n = 3000
        both = int(2 * n * share / (1 + share))
        pool = rng.integers(0, 2 ** 63, 2 * n, np.uint64) * np.uint64(2)
        a, b = pool[:n], pool[n - both:2 * n - both]
        x, y = neardup.registers(a, m), neardup.registers(b, m)
        assert (np.maximum(x, y) == neardup.registers(np.concatenate([a, b]), m)).all()
        est = neardup.joint_estimate(np.array([n * 1.0]), np.array([n * 1.0]), np.array([(x > y).sum()]), np.array([(x < y).sum()]), m)[0]
        true = both / (2 * n - both)
        assert abs(est - true) < 5 * (true * (1 - true) / m) ** 0.5 + 0.005


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {i: i for e in edges for i in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
