"""Phrase mining against a plain reading of its contract."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from tradelens.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least=30, longest=4, percent=80, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    covered = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                covered[lang, w[i:i + m]] = max(covered[lang, w[i:i + m]], a)
    scored = {}
    for (lang, w), a in found.items():
        if not (covered[lang, w] and 100 * covered[lang, w] >= percent * a):
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                        for k in range(1, len(w)))
            scored.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in scored.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def mined(df, **kw):
    return sorted(tuple(r) for r in collocations.mine_phrases(df, **kw).collect())


def texts(rnd, n, words=12):
    out = []
    for _ in range(n):
        t = "".join(rnd.choice("abcdefghijkl"[:words]) * rnd.choice([1, 1, 2]) + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", " ; ", "\x0b"])
                    for _ in range(rnd.randint(0, 60)))
        out.append(t.upper() if rnd.random() < .2 else t)
    return out


def test_random_texts(spark):
    rnd = random.Random(11)
    for words in (3, 12):
        rows = [(i, t, rnd.choice(["en", "fr", None])) for i, t in enumerate(texts(rnd, 120, words))]
        rows += [(9, "new york city hall New York City Hall x " * 9, "en"), (9, None, "en"), (10, "", None), (None, "É é É", "fr")]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        for least, longest, percent in ((5, 4, 80), (30, 4, 80), (3, 3, 50)):
            want = plain([r[1:] for r in rows], least, longest, percent)
            assert mined(df, top=2000, least=least, longest=longest, percent=percent) == want
            assert mined(df, top=7, least=least, longest=longest, percent=percent) == [w for w in want if w[1] <= 7]


def test_query_on_documents(spark, small_docs):
    rows = [(d["doc_id"], d["text"], d["lang"]) for d in small_docs]
    got = sorted(tuple(r) for r in collocations.op11(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain([r[1:] for r in rows]) and len(got) >= 50


def test_odd_rows(spark, odd_docs):
    rows, df = odd_docs
    assert sorted(tuple(r) for r in collocations.op11(df).collect()) == plain([r[1:3] for r in rows])
    assert collocations.op11(df.limit(0)).collect() == []
    assert collocations.op11(df.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_rows_and_bitmap_sizes_change_nothing(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, t, rnd.choice(["en", "fr"])) for i, t in enumerate(texts(rnd, 80))]
    df, want = spark.createDataFrame(rows, SCHEMA), plain([r[1:] for r in rows], 4)
    for size, bits in ((1, 64), (300, 64), (1 << 19, 1 << 16)):  # 64 bits: nearly all hashes meet another one
        monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
        monkeypatch.setattr(collocations, "MAX_BITS", bits)
        monkeypatch.setattr(collocations, "MIN_BITS", min(bits, 64))
        assert mined(df, top=2000, least=4) == want


def test_bitmap_has_the_hashes_of_spark(spark):
    df = spark.createDataFrame([("en", "der tag"), ("fr", "Ünï"), ("", "")], "lang string, phrase string")
    for r in df.select("lang", "phrase", F.xxhash64("lang", "phrase").alias("h")).collect():
        assert r.h % 2**64 == xxhash.xxh64_intdigest(r.phrase.encode(), xxhash.xxh64_intdigest(r.lang.encode(), 42))


def test_large_counts_are_exact(spark):
    big = 2**62
    counts = spark.createDataFrame([("en", None, 0, big), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 3),
                                    ("en", "c", 1, 2**40), ("en", "a b c", 3, big // 5 * 4 - 3), ("en", "b c", 2, big // 2)],
                                   "lang string, phrase string, k int, a long")
    got = {r.phrase: (r.l, r.r, r.score) for r in collocations.scored_phrases(counts).collect()}
    assert got["a b"] == (big, big - 1, 2000000 * (big - 3) // (2 * big - 1))
    a = big // 5 * 4 - 3
    assert got["a b c"] == min([(2000000 * a // (big + big // 2), 1, big, big // 2), (2000000 * a // (big - 3 + 2**40), 2, big - 3, 2**40)])[2:] + (
        min(2000000 * a // (big + big // 2), 2000000 * a // (big - 3 + 2**40)),)
    assert [r.phrase for r in collocations.contained(counts).collect()] == (["b c"] if 100 * a < 80 * (big - 3) else ["a b", "b c"])


def test_merge_join_is_by_piece_and_position():
    r = collocations.Occurrences("en", [b"a b. c d", b"", b"e"])
    assert r.place.tolist() == [0, 1, 3, 4, 7] and r.text.tolist() == [0, 0, 0, 0, 2]
    assert r.starts(2).tolist() == [0, 2] and r.starts(3).tolist() == []
    r.place = np.array([0, 2, 3, 4, 7])  # a word between has gone
    assert r.starts(2).tolist() == [1, 2] and r.starts(3).tolist() == [1]


def test_stored_rows_hold_the_occurrences_that_have_a_neighbour():
    r = collocations.Occurrences("en", [b"a b c x d e", b"x", b"A B, c D e f"])
    seed = xxhash.xxh64_intdigest(b"en", 42)

    def bits(*phrases):
        out = np.zeros(1 << 10, np.uint64)
        for p in phrases:
            slot = xxhash.xxh64_intdigest(p, seed) & ((1 << 16) - 1)
            out[slot >> 6] |= np.uint64(1) << np.uint64(slot & 63)
        return out

    kept = r.semi_join(r.starts(1), 1, bits(*b"abcdef".split(b" "), *(bytes([c]) for c in b"abcdef")))
    assert kept.column(1).to_pylist() == ["a b c\nd e\n", "a b\nc d e f\n"]
    twos = r.semi_join(r.starts(2), 2, bits(b"a b", b"b c", b"d e", b"c d"))
    assert twos.column(1).to_pylist() == ["a b c\n", "c d e\n"]  # "d e" and "a b" are alone where nothing follows
    assert r.semi_join(r.starts(2), 2, bits(b"a b")) is None


def test_sql_on_odd_texts(spark):
    rnd = random.Random(8)
    rows = [(i, t, rnd.choice(["en", None])) for i, t in enumerate(texts(rnd, 200, 5))]
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    c.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(c.execute(collocations.ORACLE_SQL).fetchall()) == plain([r[1:] for r in rows])
