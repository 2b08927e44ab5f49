"""Repeated byte strings against brute force, and suffix sorting against plain sorting."""

import hashlib
import random

import numpy as np

from tradelens.llm import suffixdedup as sd


def brute(rows, width=50):
    first = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        for a in range(len(data) - width + 1 if i is not None else 0):
            w = data[a:a + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - width + 1 if i is not None else 0):
            if first[data[a:a + width]] < i:
                gone[a:a + width] = True
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r)[:5] for r in sd.remove_repeats(df, **kw).collect()), key=str)


def test_documents(spark, small_docs):
    rows = [(d["doc_id"], d["text"]) for d in small_docs]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r[2] for r in want) > 0
    assert got(df) == want and got(df, block_bytes=50_000) == want


def test_odd_documents(odd_docs, spark):
    rows, df = odd_docs
    assert got(df) == brute(rows) and got(df, block_bytes=20_000) == brute(rows)
    assert got(df.limit(0)) == []


def test_planted_passages(spark):
    rnd = random.Random(6)
    passages = ["".join(rnd.choice("abc é日") for _ in range(rnd.choice([30, 48, 49, 50, 51, 80, 200]))) for _ in range(12)]
    rows = []
    for i in rnd.sample(range(1000), 70):
        parts = [rnd.choice(passages) if rnd.random() < .6 else "".join(rnd.choice("abcdef ghé") for _ in range(rnd.randint(0, 90)))
                 for _ in range(rnd.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(2000, "z" * 300), (2001, "z" * 120), (2002, "ab" * 200), (2003, "y" * 40 + "z" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes in (1 << 20, 900):
        assert got(df, block_bytes=block_bytes) == brute(rows)


def test_windows_of_segments(small_docs):
    segments = [d["text"][:200].encode() for d in small_docs if len(d["text"]) > 60] * 2
    least = np.arange(len(segments))[::-1].copy()
    length = np.array([len(s) for s in segments])
    raw = np.frombuffer(b"".join(segments), np.uint8)
    owner, offset, value = sd.equal_windows(raw, np.cumsum(length) - length, length, least)
    where = {}
    for s, low in zip(segments, least):
        for a in range(len(s) - 49):
            w = s[a:a + 50]
            where[w] = min(where.get(w, low), low)
    assert len(value) == sum(len(s) - 49 for s in segments)
    assert all(v == where[segments[i][a:a + 50]] for i, a, v in zip(owner, offset, value))


def test_parts_of_anchors_are_even(small_docs):
    h = np.concatenate([sd.anchors(d["text"].encode())[0] for d in small_docs])
    counts = np.bincount(sd._range_of(h, 20).astype(int), minlength=20)
    assert counts.max() < 2 * counts.min()


def test_suffix_order_and_common_prefixes():
    rnd = random.Random(4)
    for _ in range(150):
        text = bytes(rnd.choice([97, 98, 255, 99][:rnd.randint(1, 4)]) for _ in range(rnd.randint(1, 60))) * rnd.choice([1, 1, 2, 3])
        data = np.frombuffer(text, np.uint8)
        n = len(text)
        assert sd.smaller_than_successor(data).tolist() == [text[i:] < text[i + 1:] for i in range(n)]
        wanted = np.array([rnd.random() < .7 for _ in range(n)])
        order = sd.suffix_order(data, wanted).tolist()
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        cut = [(text[i:i + sd.DEPTH]) for i in order]
        assert cut == sorted(cut)
        lcp = sd.common_prefixes(data, np.array(order, dtype=np.int64))
        for k in range(1, len(order)):
            a, b = text[order[k - 1]:], text[order[k]:]
            same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(same, sd.DEPTH) or (same == min(len(a), len(b)) and lcp[k] >= same)


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(2)
    shared = bytes(rnd.choice(b"abc") for _ in range(120))
    a, b = b"x" * 33 + shared + b"q" * 20, b"yy" + shared + b"w" * 90
    maps = []
    for data in (a, b):
        h, first, last = sd.anchors(data)
        maps.append({data[i:i + 50]: int(x) for x, s, e in zip(h, first, last) for i in range(s, e + 1)})
        assert sorted(i for s, e in zip(first, last) for i in range(s, e + 1)) == list(range(len(data) - 49))
    assert all(maps[0][w] == maps[1][w] for w in maps[0].keys() & maps[1].keys())
