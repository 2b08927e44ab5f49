"""Runs against a plain search over all periods, the query against a plain reading of its contract."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tradelens.llm import runs


def plain_runs(t, least=6, times=4):
    n, out = len(t), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if t[i] != t[i - q]:
                i += 1
                continue
            end = i
            while end < n and t[end] == t[end - q]:
                end += 1
            start = i - q
            smaller = any(all(t[x] == t[x - d] for x in range(start + d, end)) for d in range(1, q))
            if end - start >= max(least, times * q) and not smaller:
                out.append((start, end - start, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def with_repeats(rnd, n, letters):
    t = [rnd.choice(letters) for _ in range(n)]
    for _ in range(rnd.randint(0, 2) if n > 4 else 0):
        a = rnd.randrange(n)
        p, end = rnd.randint(1, max(1, (n - a) // 3)), rnd.randint(a, n)
        for i in range(a, end):
            t[i] = t[a + (i - a) % p]
    return t


def test_random_sequences():
    rnd, found = random.Random(12), 0
    for _ in range(4000):
        t = with_repeats(rnd, rnd.randint(0, 60), "abcd"[:rnd.choice([1, 2, 2, 3, 4])])
        least, times = rnd.choice([(6, 4), (6, 4), (2, 3), (10, 5)])
        assert runs.find_runs(t, least, times) == plain_runs(t, least, times)
        found += len(plain_runs(t, least, times))
    assert found > 2000
    with pytest.raises(ValueError):
        runs.RunCatcher(times=2)


def test_items_in_any_portions():
    rnd = random.Random(5)
    for _ in range(200):
        t = with_repeats(rnd, 80, "ab")
        catcher, at = runs.RunCatcher(), 0
        while at < len(t):
            step = rnd.randint(1, 9)
            catcher.extend(t[at:at + step])
            at += step
            assert catcher.runs() == plain_runs(t[:at])  # asking does not disturb what follows


def test_long_sequences_of_known_runs():
    assert runs.find_runs(["a"] * 20_000) == [(0, 20_000, 1)]
    blocks = (["a"] * 3000 + ["b"]) * 5
    assert runs.find_runs(blocks) == sorted([(i * 3001, 3000, 1) for i in range(5)] + [(0, len(blocks), 3001)], key=lambda r: (r[0], r[2]))
    rnd = random.Random(3)
    noise = [str(rnd.randrange(10**9)) for _ in range(2000)]
    assert runs.find_runs(noise * 4) == [(0, 8000, 2000)] and runs.find_runs(noise * 4 + ["x"])[0][1] == 8000
    assert runs.find_runs(noise * 3 + noise[:1999]) == []


def contract(doc_id, text):
    words = runs.WORDS.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def test_query_as_its_contract(spark, small_docs, odd_docs):
    rows = [(d["doc_id"], (d["text"] or "")[:3000]) for d in small_docs]
    got = [tuple(r) for r in runs.op12(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(contract(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 5
    rows, df = odd_docs
    got = [tuple(r) for r in runs.op12(df).collect()]
    assert sorted(got, key=str) == sorted((contract(r[0], r[1]) for r in rows), key=str)
    assert runs.op12(df.limit(0)).collect() == []


def test_many_hashes(spark):
    rows = [(i, " ".join(f"w{j % 50}" for j in range(40))) for i in range(400)]
    got = runs.op12(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(contract(*r) for r in rows)
    assert {r.n_runs for r in got} == {0, 1}


def test_collapsed_documents_keep_their_columns(spark, odd_docs):
    rows, df = odd_docs
    out = runs.collapse_documents(df)
    assert out.columns == df.columns and out.count() == len(rows)
    texts = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert texts[0].text is None and texts[10].text == "lorem ipsum" and texts[10].n_chars == 11
    assert texts[5].text == "a b c d e f g"
